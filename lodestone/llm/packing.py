"""Packing: concatenate and cut, by two-pass prefix sums over partition token totals.

Pass one tokenises every text once and writes, per partition, its ids and their running count. The
partition totals (one number per partition) are summed on the driver and give each partition its global
offset. Pass two cuts the endless token line into windows of fixed length; a document that crosses a
boundary yields one boundary record per window it touches. Only the last window can be short.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_memory

SEQ_LEN = 1024
END_ID = 0
SPECIAL = "<|endoftext|>"


@functools.cache
def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids as the tokenizer file gives them.

    The ranks file, if given, holds the same vocabulary and is read by a faster library with equal ids; texts that contain
    the special token's string go to the tokenizer file's own library, which alone knows it.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    if ranks_path is None:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if SPECIAL in text else fast(text)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's tokens are its text's ids and then ``end_id``. ``ids_crc32`` is over little-endian
    unsigned 32-bit ids. ``with_ids`` adds the piece's ids as array<int>.

    Defined cases: a null or empty text is the end id alone; a null doc_id is carried along; repeated rows are packed
    as often as they occur; an empty table gives an empty result. Other columns are ignored. A text
    of any length is tokenised whole, in its own task's memory.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    id_type = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, ranks_path, pattern)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                ids, n, before = [], [], []
                for text in piece.column(1).to_pylist():
                    got = encode(text) if text else []
                    ids.append(np.array([*got, end_id], dtype="<u4").tobytes())
                    n.append(len(got) + 1)
                    before.append(at)
                    at += len(got) + 1
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "part", "before", "n", "ids"],
                )
        release_memory()

    tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokens = scratch.put(tokens.mapInArrow(tokenise, f"id {id_type}, part int, before long, n long, ids binary"), "tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            whose, part, before, n, ids = (batch.column(k).to_pylist() for k in range(5))
            for k in range(batch.num_rows):
                at, start = base[part[k]] + before[k], 0
                while start < n[k]:
                    seq, offset = divmod(at + start, seq_len)
                    length = min(n[k] - start, seq_len - offset)
                    raw = ids[k][4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (whose[k], start, length, zlib.crc32(raw), n[k], seq, offset, np.frombuffer(raw, "<u4").astype("i4") if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            out = [pa.array(rows[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in rows[1:7]]]
            if with_ids:
                out.append(pa.array(rows[7], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(out)])
        release_memory()

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def public_files() -> dict[str, str]:
    """The public tokenizer's files as parameters of ``pack``."""
    import public_tokenizers as files

    return {"tokenizer_path": files.path("byte_bpe_50k.json"), "ranks_path": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}
