import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import pack, public_files
from lodestone.llm.sharding import kd_shards

TEXTS = ["", None, "a b  c\n\td", "<|endoftext|> as text", "word " * 3000, "日本語 été ñ 12'345", "x", "x", "it's  we'll \u00a0 \u2003z"]


def test_pack_round_trip(spark):
    rows = [(k, t, 0, 0) for k, t in enumerate(TEXTS)] + [(None, "no id", 0, 0), (2, TEXTS[2], 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part int, ids int").repartition(3)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(frame, **public_files(), with_ids=True, seq_len=64).collect()
    for doc, text, _, _ in rows:
        want = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: (p["start"], p["sequence_id"]))
        copies = sum(r[0] == doc for r in rows)
        assert sum(p["length"] for p in got) == copies * len(want)
        for p in got:
            assert p["ids"] == want[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    line = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for seq, offset, length in line:
        assert divmod(at, 64) == (seq, offset) and offset + length <= 64
        at += length


def test_pack_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), **public_files()).collect() == []


@pytest.mark.parametrize("n", [2, 5, 16])
def test_shards(spark, n):
    rows = [(k, "t" * (k * 37 % 400), ["en", "de", None][k % 3], f"s{k % 7}", k) for k in range(900)] + [(2000 + k, "copy", "en", "s0", 1) for k in range(500)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "t" * 185, "de", "s5", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long")
    got = kd_shards(frame, n, rows_per_bucket=50).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(n))
    total = sum(r["size"] for r in got)
    for s in range(n):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / n) <= 410
    by = {r["doc_id"]: r for r in got}
    assert by[7]["size"] == 260 and by[7]["text_crc32"] == zlib.crc32(b"t" * 259)
    places: dict = {}
    for doc, text, *_ in rows:
        if doc is not None and text:
            places.setdefault(text, set()).add(by[doc]["shard"])
    assert sum(len(v) > 1 for t, v in places.items() if t != "copy") <= 2 * n


def test_shards_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert kd_shards(spark.createDataFrame([], schema), 16).collect() == []
    got = kd_shards(spark.createDataFrame([(1, "a", "en", "s"), (2, "a", "en", "s")], schema), 16).collect()
    assert len(got) == 2 and {r["slot"] for r in got} <= {0, 1}
