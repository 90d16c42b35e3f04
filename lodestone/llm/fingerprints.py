"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) the prefix array P[i] = sum of c[j] * B^j for j < i (mod p) gives the hash of any
span in constant time: (P[j] - P[i]) * B^-i. Two spans, in one text or in two, are equal if their lengths and hashes
are (p = 2^61 - 1 for single answers); a binary search over span lengths finds the longest common
extension of two positions.

The fingerprint is a sketch of the hashes of all windows of W code points: they are dealt into
K bins by their hash and the least hash of each bin stays (one-permutation minhash), so equal texts
have equal fingerprints and the share of agreeing bins estimates the windows' Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory

P61 = (1 << 61) - 1
P31 = np.uint64((1 << 31) - 1)
BASE = 1_000_003
WINDOW = 24
BINS = 64
_EMPTY = 0xFFFF


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHash:
    """Span equality and longest common extensions on one text, modulo 2^61 - 1."""

    def __init__(self, text: str):
        self.n = len(text)
        self.text, self.prefix, self.power = text, [0], [1]

    def _grow(self, n: int) -> None:
        """The arrays reach as far as spans were asked for."""
        done = len(self.prefix) - 1
        for ch in self.text[done:n]:
            self.prefix.append((self.prefix[-1] * BASE + ord(ch) + 1) % P61)
            self.power.append(self.power[-1] * BASE % P61)

    def span(self, i: int, j: int) -> int:
        if j >= len(self.prefix):
            self._grow(j)
        return (self.prefix[j] - self.prefix[i] * self.power[j - i]) % P61

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The most code points that agree from i here and from j in the other text."""
        lo, most, step = 0, min(self.n - i, other.n - j), 1
        while step <= most and self.equal(i, other, j, step):
            lo, step = step, 2 * step
        hi = min(step - 1, most) if step <= most else most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, other, j, mid) else (lo, mid - 1)
        return lo


def _mod31(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62, as 0 .. 2^31 - 1."""
    x = (x & P31) + (x >> np.uint64(31))
    return (x & P31) + (x >> np.uint64(31))


class Sketcher:
    """Window hashes from prefix arrays modulo 2^31 - 1; tables of powers grow with the longest text."""

    def __init__(self, window: int = WINDOW, bins: int = BINS):
        self.window, self.bins = window, bins
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        n = max(n, 2 * len(self.power), 4096)
        for name, base in (("power", BASE), ("inverse", pow(BASE, -1, int(P31)))):
            table = np.ones(n, np.uint64)
            filled = 1
            while filled < n:  # doubling: table[filled + k] = table[k] * base^filled
                step = np.uint64(pow(base, filled, int(P31)))
                take = min(filled, n - filled)
                table[filled : filled + take] = table[:take] * step % P31
                filled += take
            setattr(self, name, table)

    def windows(self, text: str) -> np.ndarray:
        """The hash of every window of the text; of the whole text if it is shorter than a window."""
        c = code_points(text).astype(np.uint64) + np.uint64(1)
        n = len(c)
        if not n:
            return np.zeros(0, np.uint64)
        self._powers(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mod31(c * self.power[:n]), out=prefix[1:])
        prefix = _mod31(prefix)
        w = min(self.window, n)
        spans = _mod31(prefix[w:] + P31 - prefix[:-w]) if w <= n else prefix[:0]
        return _mod31(spans * self.inverse[: n - w + 1]) % P31

    def fingerprint(self, text: str) -> str:
        """4 hexadecimal digits a bin: the least hash in it, or ffff for none."""
        h = self.windows(text)
        sketch = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        if len(h):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(7))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            np.minimum.at(sketch, (h % np.uint64(self.bins)).astype(np.intp), h >> np.uint64(8))
        short = np.where(sketch == np.iinfo(np.uint64).max, _EMPTY, (sketch & np.uint64(0xFFFF)) % np.uint64(_EMPTY)).astype(">u2")
        return short.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of bins that agree, of those filled in either; 1 for two empty texts."""
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    filled = (x != _EMPTY) | (y != _EMPTY)
    return float((x == y)[filled].mean()) if filled.any() else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row's whole text, without a shuffle.

    Defined cases: a null text counts as empty; an empty text has no windows (all bins ffff); a text
    shorter than the window is one span; a null id is carried along; repeated rows repeat.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(window, bins)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketcher.fingerprint(t) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_chars long, fingerprint string")


def compare_spans(rows: DataFrame, a_col: str = "a", i_col: str = "i", b_col: str = "b", j_col: str = "j", length_col: str = "length") -> DataFrame:
    """The rows with their columns, and equal (a from i and b from j agree on ``length`` code points), extension (on how many they agree at most).

    Defined cases: a null text counts as empty; a span that leaves a text is not equal; both are null where a place is null
    or outside its text (its end is inside), equal also where the length is null or negative. Columns named equal and extension are replaced.
    """
    rows = rows.drop("equal", "extension")
    at = [rows.columns.index(c) for c in (a_col, i_col, b_col, j_col, length_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal, extension = [], []
            for a, i, b, j, n in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                x, y = PrefixHash(a or ""), PrefixHash(b or "")
                inside = i is not None and j is not None and 0 <= i <= x.n and 0 <= j <= y.n
                extension.append(x.extension(i, y, j) if inside else None)
                equal.append(i + n <= x.n and j + n <= y.n and x.equal(i, y, j, n) if inside and n is not None and n >= 0 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(equal, pa.bool_()), pa.array(extension, pa.int64())], names=[*batch.schema.names, "equal", "extension"])

    schema = T.StructType([*rows.schema.fields, T.StructField("equal", T.BooleanType()), T.StructField("extension", T.LongType())])
    return rows.mapInArrow(run, schema)


def with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt into ranges of descending id, each range followed by the first row of the next one.

    Columns: id, text, own (false for that extra row). The order in a range is id descending, nulls
    last, then text. Only the texts cross the network, once; the range bounds come from the
    ids alone and are ``parts`` numbers on the driver (default: the number of shuffle partitions).
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id").filter(F.col("id").isNotNull())
    marks = ids.agg(F.percentile_approx("id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(20 * parts)).alias("q")).first()["q"] if parts > 1 else []
    marks = sorted(set(marks or []))
    raw = _range_of(F.col("id"), marks, {k: k for k in range(-1, len(marks) + 1)})
    held = {r["k"]: r["first"] for r in ids.select(raw.alias("k"), "id").groupBy("k").agg(F.max("id").alias("first")).collect()}
    null_first = rows.filter(F.col("id").isNull()).agg(F.min_by(F.xxhash64("text"), "text")).first()[0]  # the hash of the first text without an id
    has_null = null_first is not None
    order = sorted(held, reverse=True) + [-1] * has_null  # from the largest ids down, nulls last
    if not order:
        return rows.select("id", "text", F.lit(True).alias("own"))
    dense = {k: j for j, k in enumerate(order)}
    at = _range_of(F.col("id"), marks, {k: dense.get(k, 0) for k in range(-1, len(marks) + 1)})
    is_first = F.col("id").isin(list(held.values())) | (F.col("id").isNull() & (F.xxhash64("text") == F.lit(null_first).cast("long")))
    keyed = rows.select("id", "text", at.alias("p"))
    own = F.struct("p", F.lit(True).alias("own"))
    extra = F.struct(F.pmod(F.col("p") - 1, F.lit(len(order))).alias("p"), F.lit(False).alias("own"))
    dealt = keyed.select("id", "text", F.explode(F.when(is_first, F.array(own, extra)).otherwise(F.array(own))).alias("c")).select("id", "text", "c.p", "c.own")
    return dealt.repartitionById(len(order), F.col("p")).sortWithinPartitions(F.col("own").desc(), F.col("id").desc_nulls_last(), "text").select("id", "text", "own")


def _range_of(c: Column, marks: list, value: dict[int, int]) -> Column:
    """value[k] for ids in (marks[k-1], marks[k]], value[-1] for null; a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(value[lo])
        mid = (lo + hi) // 2
        return F.when(c <= marks[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(c.isNull(), F.lit(value[-1])).otherwise(tree(0, len(marks))).cast("int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_next.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document by descending id; the last document's next is the first. common_next is how many code points the two texts have in common at their start.

    Defined cases: a null text counts as empty; null ids come last; equal ids are ordered by text, so
    repeated rows are neighbours; a single document is its own next one; an empty table gives an empty result.
    A text is held whole in one task, with its prefix arrays.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(window, bins)
        held = None  # the row before: id, text, fingerprint, own

        def close(text: str, print_: str) -> None:
            doc, own_text, own_print, _ = held
            half = len(own_text) // 2
            edited = own_text[: len(own_text) - half] + text[:half]
            edited_print = own_print if edited == own_text else sketcher.fingerprint(edited)
            row = (doc, len(own_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, print_), PrefixHash(own_text).extension(0, PrefixHash(text), 0))
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, text, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                print_ = sketcher.fingerprint(text)
                if held is not None and held[3]:
                    close(text, print_)
                held = (doc, text, print_, own)
            types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next"])
        release_memory()

    return with_neighbour(docs, id_col, text_col).mapInArrow(run, schema)
