"""N-gram Jaccard join with parity sketches.

A document is the set of 64-bit hashes of its five-word shingles. Its parity sketch for a size band has P parts; every shingle is dealt
to one part by its hash and its hash is XORed into it. A shingle that only one of two sets has changes one part, so the number
of parts in which two sketches differ is a lower bound of the symmetric difference. Sets of sizes a and b with a Jaccard similarity of
at least 3/4 differ in at most t = (a + b) / 7 elements. Hence (pigeonhole) of a set's D parts that hold something at least D - t agree with
a similar set's; and when the parts of all sets (as keys: part and value) are put in one global order, the first t + 1 of two similar
sets have one in common. A part at place i of a set (from 0) can only be the first that it shares with a set of size 7 i - a or more.
A set whose shingles fill t parts or fewer also has its empty parts as keys, after the others.

Bands have ratio 4; a set that can have a smaller partner in the band below is also sketched there.

1. Every part of every sketch goes to the bucket of its key, once per unit (some megabytes of texts) and key. Each bucket
   tells the units which keys several sets have, and how many.
2. Each unit drops the sets that share fewer than D - t parts. The others keep the first t + 1 of their keys in the order by
   number of sets, rarest first; keys that no other set has need not be stored, they come first. This is the pigeonhole join.
   Passages that many documents quote come last in the order, so they are rarely joined on; the order is exact and never changes the result.
3. Keys with the same sets are one group. Each group's hub (the set that shares the largest part of its sketch) is compared
   with the others. Sets that are linked are one component.
4. Of the groups whose sets are not all connected, the sets of different components are compared in blocks, by parity sketches of about a
   bit an element; only pairs that these leave possible come out, of two components in a group the nearest ones first.

Possible pairs are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_memory
from .components import connected_components

WORDS = 5
#: Bytes of shingle hashes of a unit, and its documents at most.
UNIT_BYTES = 12 << 20
UNIT_DOCS = 16_000
#: Keys of a bucket, on average.
BUCKET_KEYS = 2_000_000
#: Sets of a group that are compared in one block with another such block.
BLOCK = 2048
#: Up to so many texts are picked with a broadcast bitmap (16 bits each), more with a join.
BITMAP_TEXTS = 4 << 20
#: Pairs of two components that are verified at first, nearest ones; eight times as many in each further round, in the groups that have more.
NEAREST = 4
KEY_BITS = 40
U = np.uint64
_MIX = U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# per byte: a random value (A-Z as a-z), 0 for the ASCII white space that separates words
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[[32, 9, 10, 11, 12, 13]] = 0
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            table, filled = np.ones(size, U), 1
            while filled < size:
                take = min(filled, size - filled)
                table[filled : filled + take] = table[:take] * U(pow(base, filled, 1 << 64))
                filled += take
            _powers[k] = table
    return _powers


class Sets:
    """The shingle sets of a run of texts: sorted distinct 64-bit hashes, those of text k at starts[k] to starts[k + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
        """``data``: the texts' UTF-8 bytes, text k at offsets[k] to offsets[k + 1]."""
        docs = len(offsets) - 1
        value = _VALUE[data]
        solid = value != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], solid[:-1])) if len(data) else solid
        first = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.concatenate((solid[1:], [False])) if len(data) else solid
        last = np.flatnonzero(solid & (~after | edge[1:])) + 1
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(value * power[: len(data)], out=total[1:])
        word = mix((total[last] - total[first]) * inverse[first])
        at = np.searchsorted(first, offsets)  # word k of text d: at[d] + k
        n_words = np.diff(at)
        n_grams = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
        raw = np.concatenate(([0], np.cumsum(n_grams)))
        doc = np.repeat(np.arange(docs), n_grams)
        place = np.arange(raw[-1]) - raw[doc] + at[doc]
        gram = np.zeros(raw[-1], U)
        padded = np.concatenate((word, np.zeros(words, U)))
        factor = [mix(np.array([k + 1], U))[0] | U(1) for k in range(words)]
        whole = n_words[doc] >= words
        for k in range(words):
            part = padded[place + k] * factor[k]
            gram += np.where(whole | (k < n_words[doc]), part, U(0))
        gram = mix(gram + np.minimum(n_words, words)[doc].astype(U))
        for d in np.flatnonzero(n_grams > 1):
            gram[raw[d] : raw[d + 1]].sort()
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        self.items = gram[new]
        self.owner = doc[new]
        self.sizes = np.bincount(self.owner, minlength=docs)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def of(self, k: int) -> np.ndarray:
        return self.items[self.starts[k] : self.starts[k + 1]]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """127 bits that stand for each set, as two signed arrays; 0 for an empty set."""
        out = np.zeros((2, len(self.sizes)), U)
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[0, full] = np.bitwise_xor.reduceat(mix(self.items + U(11)), self.starts[full]) & ~U(1)
            out[1, full] = np.add.reduceat(mix(self.items ^ U(0x5851F42D4C957F2D)), self.starts[full])
        return out[0].view(np.int64), out[1].view(np.int64)

    def bits(self, chosen: np.ndarray) -> list[bytes]:
        """The whole sets' parity sketches of ``sketch_bits`` bits: an element flips the bit of its value modulo the length."""
        out = []
        for k in chosen:
            x = self.of(k)
            length = int(sketch_bits(band_of(np.array([len(x)])))[0])
            flips = np.bincount((x & U(length - 1)).astype(np.int64), minlength=length) & 1
            out.append(np.packbits(flips.astype(bool), bitorder="little").tobytes())
        return out


def sets_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, Sets]]:
    """(first row, sets) of runs of an Arrow string column, about ``limit`` bytes of whole texts each; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1), lo + UNIT_DOCS // 4)
        yield lo, Sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return Sets(raw, np.array([0, len(raw)])).items


def band_of(sizes: np.ndarray) -> np.ndarray:
    """The band k of each size: from 4^k up to 4^(k + 1)."""
    return (np.frexp(sizes.astype(float))[1].astype(np.int64) - 1) // 2


def sketch_bits(band: np.ndarray) -> np.ndarray:
    """Bits of a whole set's sketch; a sketch folds onto that of the band below."""
    return np.maximum(1024, 4 ** (band + 1))


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """A sketch of 64-bit words as one of ``length`` bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, length // 64), axis=0)


def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most elements in which similar sets of these sizes differ."""
    return (a + b) // 7


def parts_of(s: Sets, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the own band, then the band below: sets, filled parts D, most that a similar set can lack t, and keys with the owner's place among the sets.

    ``chosen`` are non-empty sets; in the band below only those with a possible partner there. Sets with D <= t have their empty parts as keys too.
    """
    n = s.sizes[chosen]
    band = band_of(n)
    down = (band > 0) & (-(-3 * n // 4) < 4**band)
    for low, (take, bands) in enumerate(((chosen, band), (chosen[down], band[down] - 1))):
        n = s.sizes[take]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        x = s.items[np.repeat(s.starts[take] - (ends - n), n) + np.arange(total)]
        owner = np.repeat(np.arange(len(take)), n)
        parts = np.maximum(3 * 4**bands, 16)
        start = np.concatenate(([0], np.cumsum(parts)))
        place = start[owner] + ((x >> U(32)) * parts[owner].astype(U) >> U(32)).astype(np.int64)
        value = np.zeros(int(start[-1]), U)
        np.bitwise_xor.at(value, place, mix(x + U(77)))
        filled = np.zeros(len(value), bool)
        filled[place] = True
        holds = np.add.reduceat(filled, start[:-1], dtype=np.int64) if len(take) else np.zeros(0, np.int64)
        most = allowed(n, np.minimum(4 * n // 3, 4 ** (bands + 1) - 1) if low else 4 * n // 3)
        wanted = filled | np.repeat(holds <= most, parts)
        at = np.flatnonzero(wanted)
        owner = np.repeat(np.arange(len(take)), parts)[at]
        name = (at - start[owner]).astype(U) * U(64) + bands[owner].astype(U) * U(2) + filled[at].astype(U)
        yield take, holds, most, mix(value[at] ^ mix(name)), owner


#: kind 0: a document (id, k, n, s1, s2). 1: keys of a unit on their way to their bucket. 2: the sets of a unit, and the groups that share a
#: key within it. 3: keys of a unit that several sets have, on their way back.
_FIELDS = (
    ("kind", pa.int32(), "int"), ("bucket", pa.int32(), "int"), ("unit", pa.int64(), "long"), ("k", pa.int64(), "long"), ("n", pa.int64(), "long"), ("s1", pa.int64(), "long"),
    ("s2", pa.int64(), "long"), ("a", pa.binary(), "binary"), ("b", pa.binary(), "binary"), ("c", pa.binary(), "binary"), ("d", pa.binary(), "binary"), ("e", pa.binary(), "binary"),
)
_ROW = ", ".join(f"{n} {t}" for n, _, t in _FIELDS)


def _batch(count: int, id_type: pa.DataType, ids: pa.Array | None = None, **columns) -> pa.RecordBatch:
    arrays = [ids if ids is not None else pa.nulls(count, id_type)]
    for name, kind, _ in _FIELDS:
        given = columns.get(name)
        arrays.append(pa.nulls(count, kind) if given is None else given if isinstance(given, pa.Array) else pa.array(given, kind))
    return pa.RecordBatch.from_arrays(arrays, names=["id", *[f[0] for f in _FIELDS]])


def _packed(keys: np.ndarray) -> bytes:
    """The low KEY_BITS of keys."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _unpacked(raw: memoryview) -> np.ndarray:
    out = np.zeros((len(raw) // (KEY_BITS // 8), 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


class _Unit:
    """The distinct sets of some texts and the keys of their parts, gathered run by run."""

    def __init__(self):
        self.s1, self.n, self.filled, self.most, self.keys, self.owners = [], [], [], [], [], []
        self.seen: dict[tuple[int, int], int] = {}
        self.bytes = 0

    def add(self, s: Sets, ids: tuple[np.ndarray, np.ndarray]) -> None:
        fresh = []
        for k, name in enumerate(zip(ids[0].tolist(), ids[1].tolist(), strict=True)):
            if s.sizes[k] and name not in self.seen:
                self.seen[name] = 1
                fresh.append(k)
        fresh = np.array(fresh, np.int64)
        base = sum(map(len, self.s1))
        self.s1.append(ids[0][fresh])
        self.n.append(s.sizes[fresh])
        at = np.zeros(len(s.sizes), np.int64)
        at[fresh] = base + np.arange(len(fresh))
        filled, most = np.zeros((2, len(fresh)), np.int64), np.zeros((2, len(fresh)), np.int64)
        for low, (take, holds, lacks, keys, owner) in enumerate(parts_of(s, fresh)):
            filled[low, at[take] - base], most[low, at[take] - base] = holds, lacks
            self.keys.append(keys)
            self.owners.append((at[take][owner] * 2 + low).astype(np.uint16))
        self.filled.append(filled)
        self.most.append(most)
        self.bytes += 8 * len(s.items)

    def rows(self, unit: int, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not any(map(len, self.s1)):
            return
        s1, n = np.concatenate(self.s1), np.concatenate(self.n)
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        bucket = (keys >> U(KEY_BITS)) * U(buckets) >> U(64 - KEY_BITS)
        keys = (bucket << U(KEY_BITS)) | (keys & U((1 << KEY_BITS) - 1))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        cut = _runs(keys)
        first, count = cut[:-1], np.diff(cut)
        many = count > 1
        inside = np.repeat(many, count)
        home = int(mix(np.array([unit], U))[0] % U(buckets))
        yield _batch(
            1, id_type, kind=[2], bucket=[home], unit=[unit], a=[s1.tobytes()], b=[np.stack([n, *np.concatenate(self.filled, axis=1), *np.concatenate(self.most, axis=1)]).astype("<i4").tobytes()],
            c=[keys[first[many]].tobytes()], d=[count[many].astype("<u4").tobytes()], e=[owners[inside].tobytes()],
        )
        keys, owners = keys[first], owners[first]
        to = (keys >> U(KEY_BITS)).astype(np.int64)
        spans = _runs(to)
        out: list[list] = [[], [], [], [], [], []]
        for x, y in zip(spans, spans[1:], strict=False):
            at = np.arange(x, y)
            at = np.concatenate((at[many[x:y]], at[~many[x:y]]))  # keys with several sets first
            docs = np.unique(owners[at] >> 1)
            found = (int(to[x]), _packed(keys[at]), owners[at].tobytes(), count[at][: int(many[x:y].sum())].astype("<u4").tobytes(), docs.tobytes(), s1[docs].tobytes())
            for column, value in zip(out, found, strict=True):
                column.append(value)
        m = len(out[0])
        yield _batch(m, id_type, kind=[1] * m, bucket=out[0], unit=[unit] * m, **dict(zip("abcde", out[1:], strict=True)))


def _shared(rows: list[tuple], bucket: int, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The keys of a bucket that several sets have, for each unit: keys, numbers of sets, owners."""
    keys = np.concatenate([_unpacked(r[1]) for r in rows])
    which = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 2 for r in rows])
    owners = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows])
    count = np.ones(len(keys), np.uint32)
    sets = np.zeros(len(keys), np.int64)
    at = 0
    for _, _, own, multi, docs, s1 in rows:
        own = np.frombuffer(own, np.uint16)
        multi = np.frombuffer(multi, "<u4")
        count[at : at + len(multi)] = multi
        sets[at : at + len(own)] = np.frombuffer(s1, np.int64)[np.searchsorted(np.frombuffer(docs, np.uint16), own >> 1)]
        at += len(own)
    order = np.argsort(keys, kind="stable")
    cut = _runs(keys[order])
    lead, size = cut[:-1], np.diff(cut)
    sets, count = sets[order], count[order]
    total = np.add.reduceat(count, lead, dtype=np.int64)
    several = (np.minimum.reduceat(sets, lead) != np.maximum.reduceat(sets, lead)) | (np.maximum.reduceat(count, lead) > 1)
    del sets, count
    take = order[np.repeat(several, size)]
    total = np.repeat(total[several], size[several])
    by = np.argsort(which[take], kind="stable")
    take, total = take[by], total[by]
    spans = _runs(which[take])
    units = [rows[which[take[x]]][0] for x in spans[:-1]]
    cuts = list(zip(spans, spans[1:], strict=False))
    yield _batch(
        len(units), id_type, kind=[3] * len(units), unit=units, bucket=[int(mix(np.array([u], U))[0] % U(buckets)) for u in units],
        a=[(keys[take[x:y]] | U(bucket << KEY_BITS)).tobytes() for x, y in cuts], b=[np.minimum(total[x:y], 0xFFFFFFFF).astype("<u4").tobytes() for x, y in cuts], c=[owners[take[x:y]].tobytes() for x, y in cuts],
    )


def _deal(rows: DataFrame, scratch: Scratch, id_type: str) -> tuple[DataFrame, DataFrame, int]:
    """Written tables: documents (id, k, n, s1, s2), and what units keep and get back."""
    conf = rows.sparkSession.conf
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(conf.get("spark.sql.shuffle.partitions")), characters // 6 // BUCKET_KEYS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, work = TaskContext.get().partitionId() << 24, _Unit()
        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for lo, s in sets_of(batch.column(2)):
                n, ids = len(s.sizes), s.ids()
                yield _batch(n, id_arrow, batch.column(0).slice(lo, n), kind=np.zeros(n, np.int32), bucket=((np.arange(lo, lo + n) + unit) % buckets).astype(np.int32), k=batch.column(1).slice(lo, n), n=s.sizes.astype(np.int64), s1=ids[0], s2=ids[1])
                if len(work.seen) + n > UNIT_DOCS or (work.seen and work.bytes + 8 * len(s.items) > UNIT_BYTES):
                    yield from work.rows(unit, buckets, id_arrow)
                    unit, work = unit + 1, _Unit()
                work.add(s, ids)
        yield from work.rows(unit, buckets, id_arrow)
        del work
        release_memory()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, id_arrow = [], 0, pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            plain = batch.filter(pa.array(kind != 1))
            if plain.num_rows:
                yield plain
            for r in np.flatnonzero(kind == 1):
                bucket = batch.column(2)[r].as_py()
                held.append((batch.column(3)[r].as_py(), *(batch.column(c)[r].as_py() for c in range(8, 13))))
        if held:
            yield from _shared(held, bucket, buckets, id_arrow)
        del held
        release_memory()

    schema = f"id {id_type}, {_ROW}"
    dealt = rows.select("id", "k", "text").mapInArrow(deal, schema).repartitionById(buckets, F.col("bucket")).mapInArrow(gather, schema)
    table = scratch.put(dealt, "parts")
    return table.filter("kind = 0").select("id", "k", "n", "s1", "s2"), table.filter("kind >= 2").select("bucket", "kind", "unit", *"abcde"), buckets


def _chosen_of(own: tuple, back: list[tuple]) -> pa.RecordBatch | None:
    """The keys of a unit that its sets are joined on: key, s1, n, band, the least size of a partner, share of parts that others have."""
    s1 = np.frombuffer(own[0], np.int64)
    n, *rest = np.frombuffer(own[1], "<i4").reshape(5, -1).astype(np.int64)
    filled, most = np.stack(rest[:2], axis=1).ravel(), np.stack(rest[2:], axis=1).ravel()  # owner 2 k + 1: set k in the band below
    keys = np.concatenate([np.frombuffer(r[0], U) for r in back])
    sets = np.concatenate([np.frombuffer(r[1], "<u4") for r in back]).astype(np.int64)
    owners = np.concatenate([np.frombuffer(r[2], np.uint16) for r in back]).astype(np.int64)
    inner, sizes, members = np.frombuffer(own[2], U), np.frombuffer(own[3], "<u4").astype(np.int64), np.frombuffer(own[4], np.uint16).astype(np.int64)
    if len(inner):
        at = np.minimum(np.searchsorted(inner, keys), len(inner) - 1)
        multi = np.flatnonzero(inner[at] == keys)
        at = at[multi]
        start = (np.cumsum(sizes) - sizes)[at]
        size = sizes[at]
        ends = np.cumsum(size)
        whole = members[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        single = np.ones(len(keys), bool)
        single[multi] = False
        owners = np.concatenate((owners[single], whole))
        keys, sets = (np.concatenate((v[single], np.repeat(v[multi], size))) for v in (keys, sets))
    count = np.bincount(owners, minlength=len(filled))
    need = np.maximum(filled - most, 1)
    keep = (count >= need)[owners]
    keys, sets, owners = keys[keep], sets[keep], owners[keep]
    if not len(keys):
        return None
    order = np.lexsort((keys, sets, owners))
    keys, owners = keys[order], owners[order]
    cut = _runs(owners)
    place = np.arange(len(owners)) - np.repeat(cut[:-1], np.diff(cut))
    keep = place <= (count - need)[owners]
    keys, owners, place = keys[keep], owners[keep], place[keep]
    place += np.maximum(filled - count, 0)[owners]  # keys that no other set has come first
    size = n[owners >> 1]
    band = band_of(size) - (owners & 1)
    least = np.where((filled <= most)[owners], 0, 7 * place - size)
    score = count[owners] / np.maximum(filled[owners], 1)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(s1[owners >> 1]), pa.array(size), pa.array(band.astype(np.int32)), pa.array(least), pa.array(score)], names=["key", "s1", "n", "band", "least", "score"])


def _choose(units: DataFrame, buckets: int) -> DataFrame:
    """(key, s1, n, band, least, score): step 2. A unit's rows are sorted next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, back = None, None, []
        for batch in batches:
            for r in range(batch.num_rows):
                unit = batch.column(2)[r].as_py()
                if unit != now:
                    if own and back and (got := _chosen_of(own, back)):
                        yield got
                    now, own, back = unit, None, []
                row = tuple(batch.column(c)[r].as_py() for c in range(3, 8))
                if batch.column(1)[r].as_py() == 2:
                    own = row
                else:
                    back.append(row)
        if own and back and (got := _chosen_of(own, back)):
            yield got
        release_memory()

    dealt = units.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "key long, s1 long, n long, band int, least long, score double")


def _held(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose hash k is among those of ``wanted``, before they are shuffled: by a broadcast bitmap, which lets some more pass, or of very many by a join."""
    count = wanted.count()
    if count > BITMAP_TEXTS:
        return rows.join(wanted.select("k").distinct(), "k", "left_semi")
    mask = (1 << max(10, (16 * count).bit_length())) - 1
    word, bit = F.expr(f"shiftright(k & {mask}L, 6)"), F.expr("shiftleft(1L, cast(k & 63 as int))")
    bitmap = wanted.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("set"))
    return rows.withColumn("w", word).join(F.broadcast(bitmap), "w").filter(F.col("set").bitwiseAND(bit) != 0).select(*rows.columns)


def _sets(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(s1, n, bits, elements) of the sets in ``wanted`` (s1, s2, k), recomputed from the texts of the rows with hash k."""
    texts = _held(rows.select("k", "text"), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in sets_of(batch.column(1)):
                one, two = s.ids()
                _, at = np.unique(np.stack([one, two]), axis=1, return_index=True)
                at = at[s.sizes[at] > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at]), pa.array(two[at]), pa.array(s.sizes[at].astype(np.int64)), pa.array(s.bits(at), pa.binary()), pa.array([s.of(k).tobytes() for k in at], pa.binary())], names=["s1", "s2", "n", "bits", "elements"]
                )
        release_memory()

    found = texts.mapInArrow(run, "s1 long, s2 long, n long, bits binary, elements binary")
    found = found.join(wanted.select("s1", "s2"), ["s1", "s2"], "left_semi").dropDuplicates(["s1", "s2"])
    return scratch.put(found.drop("s2"), "sets")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                na, nb = batch.column(2)[r].as_py(), batch.column(4)[r].as_py()
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), U) for c in (3, 5))
                length = 64 * min(len(x), len(y))
                keep[r] = np.bitwise_count(folded(x, length) ^ folded(y, length)).sum() <= (na + nb) // 7
            yield batch.select([0, 1]).filter(pa.array(keep))
        release_memory()

    own = lambda c: sets.select(F.col("s1").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return both.select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose intersection is large enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), U) for c in (2, 3))
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[r] = 7 * common >= 3 * (len(x) + len(y))
            yield batch.select([0, 1]).filter(pa.array(keep))
        release_memory()

    own = lambda c: sets.select(F.col("s1").alias(c), F.col("elements").alias(f"x{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _possible_pairs(s1: np.ndarray, n: np.ndarray, least: np.ndarray, comp: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of ``left`` and ``right`` sets of different components that sizes, places and sketches allow; of two components the ``limit`` nearest ones, and if there are more."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    words = bits.shape[1]
    step = max(1, 500_000 // max(1, len(right)))
    for lo in range(0, len(left), step):
        a = left[lo : lo + step, None]
        b = right[None, :]
        fits = (comp[a] != comp[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])) & (n[b] >= least[a]) & (n[a] >= least[b])
        if left is right:
            fits &= a < b
        x, y = np.nonzero(fits)
        x, y = left[lo + x], right[y]
        for at in range(0, len(x), max(1, 1_000_000 // words)):
            p, q = x[at : at + max(1, 1_000_000 // words)], y[at : at + max(1, 1_000_000 // words)]
            apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
            near = 7 * apart <= n[p] + n[q]
            if near.any():
                found.append((p[near], q[near], apart[near] / (n[p[near]] + n[q[near]])))
    if not found:
        return s1[:0], s1[:0], False
    p, q, far = map(np.concatenate, zip(*found, strict=True))
    c, d = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
    order = np.lexsort((q, p, far, d, c))
    p, q, c, d = p[order], q[order], c[order], d[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
    place = np.arange(len(p)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = place < limit
    return s1[p[keep]], s1[q[keep]], not keep.all()


def _across(live: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """(a, b, more) for the live groups' members (g, band, s1, n, least, comp): step 4. Groups of more than BLOCK sets are compared block by block.

    A row with ``more`` holds the g and band of a group that has further pairs.
    """
    blocks = live.groupBy("g", "band").agg(F.count("*").alias("m")).select("g", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = live.join(blocks, ["g", "band"]).withColumn("block", F.expr("cast(pmod(xxhash64(s1), blocks) as int)"))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    hashed = F.xxhash64("s1").alias("k")
    bits_of = _held(sets.select("s1", "bits", hashed), live.select(hashed)).drop("k")
    dealt = pairs.join(bits_of, "s1").select("g", "band", "x", "y", "block", "s1", "n", "least", "comp", "bits")
    count = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "g", "band", "x", "y").sortWithinPartitions("g", "band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(head: tuple, parts: list[tuple[np.ndarray, ...]], bits: list[bytes]) -> pa.RecordBatch:
            block, s1, n, least, comp = (np.concatenate(v) for v in zip(*parts, strict=True))
            length = int(sketch_bits(np.array([head[1]]))[0])
            table = np.stack([folded(np.frombuffer(b, U), length) for b in bits])
            left, right = np.flatnonzero(block == head[2]), np.flatnonzero(block == head[3])
            a, b, more = _possible_pairs(s1, n, least, comp, table, left, left if head[2] == head[3] else right, limit)
            if more:
                a, b = np.append(np.minimum(a, b), head[0]), np.append(np.maximum(a, b), head[1])
            else:
                a, b = np.minimum(a, b), np.maximum(a, b)
            flag = np.zeros(len(a), bool)
            flag[len(a) - 1 :] = more
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flag)], names=["a", "b", "more"])

        head, parts, bits = None, [], []
        for batch in batches:
            named = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            cut = np.concatenate(([0], np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1, [len(named)])) if len(named) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                now = tuple(named[lo].tolist())
                if now != head:
                    if parts:
                        yield compared(head, parts, bits)
                    head, parts, bits = now, [], []
                parts.append(tuple(batch.column(c).slice(lo, hi - lo).to_numpy().astype(np.int64) for c in range(4, 9)))
                bits += batch.column(9).slice(lo, hi - lo).to_pylist()
        if parts:
            yield compared(head, parts, bits)
        del parts, bits
        release_memory()

    return dealt.mapInArrow(run, "a long, b long, more boolean")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= 75 * union of their distinct five-word shingles;
    component_id is the least id that links lead to. Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z
    lower-cased; fewer than five words are one shingle.

    Defined cases: a null text, an empty one or one of white space has no shingle and links with nothing. A null id
    takes part in links but is never a component_id, unless its component has no other id. Rows with equal
    texts (repeated rows too) have one set and one component. An empty table gives an empty result. Other columns are
    ignored. A text is held whole in one task, with its shingles.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "jaccard-join")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    sets_of_docs, units, buckets = _deal(rows, scratch, id_type)
    classes = sets_of_docs.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("least"), F.min("k").alias("k"))
    classes = scratch.put(classes, "classes")
    chosen = scratch.put(_choose(units, buckets), "chosen")

    # keys with the same sets, told by the extremes of two hashes of them, are one group; groups that are told alike only grow
    one, two = F.xxhash64("s1"), F.xxhash64("s1", F.lit(7))
    alike = chosen.groupBy("key").agg(F.min(one).alias("p"), F.max(one).alias("q"), F.min(two).alias("r"), F.max(two).alias("s")).filter("p <> q")
    alike = alike.select("key", F.xxhash64("p", "q", "r", "s").alias("g"))
    members = chosen.join(alike, "key").groupBy("g", "band", "s1", "n").agg(F.min("least").alias("least"), F.max("score").alias("score"))
    members = scratch.put(members, "members")
    scratch.drop(chosen)
    wanted = scratch.put(members.select("s1").distinct().join(classes, "s1").select("s1", "s2", "k"), "wanted")
    sets = _sets(rows, wanted, scratch)

    hubs = members.groupBy("g", "band").agg(F.max_by(F.struct("s1", "n", "least"), F.struct("score", "s1")).alias("hub"))
    spokes = members.join(hubs, ["g", "band"]).filter("s1 <> hub.s1 AND 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)")
    edges = spokes.select(F.least("s1", "hub.s1").alias("a"), F.greatest("s1", "hub.s1").alias("b")).distinct()
    near = scratch.put(_near(edges, sets), "near")
    links = scratch.put(_linked(near, sets), "links")
    comps = connected_components(links, scratch)
    limit, again = NEAREST, None
    while True:
        placed = members.join(comps.select(F.col("node").alias("s1"), "comp"), "s1", "left").withColumn("comp", F.coalesce("comp", "s1"))
        mixed = placed.groupBy("g", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("g", "band")
        if again is not None:  # of the other groups every possible pair has been verified
            mixed = mixed.join(again, ["g", "band"], "left_semi")
        live = scratch.put(placed.join(mixed, ["g", "band"], "left_semi"), "live")
        found = scratch.put(_across(live, sets, limit).distinct(), "possible")
        possible = found.filter("NOT more").select("a", "b").join(near, ["a", "b"], "left_anti")
        new = scratch.put(_linked(possible, sets), "links")
        if not new.isEmpty():
            links = links.union(new)
            comps = connected_components(links, scratch)
        again = found.filter("more").select(F.col("a").alias("g"), F.col("b").cast("int").alias("band"))
        if again.isEmpty():
            break
        limit *= 8

    of_class = classes.join(comps.withColumnRenamed("node", "s1"), "s1", "left").select("s1", "s2", "n", "least", F.coalesce("comp", "s1").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = scratch.put(of_class.join(least, "comp").select("s1", "s2", "n", "component_id"), "named")
    out = sets_of_docs.join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.other) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
