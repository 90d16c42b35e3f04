"""Language ID by error-correcting output codes over character n-grams.

Every language has a codeword; one binary linear classifier per bit, trained on hashed n-grams of
words (1 to 3 characters, with word boundaries), predicts that bit. Decoding sums, for each language,
the logistic loss of each bit's margin against its codeword, weighted by how well the bit did in training, and takes the least; a
small lead over the second marks the text as ambiguous.

A text's margin is the mean over its words, so a word's margins are computed once and kept in a
bounded cache. Training reads at most ``sample_rows`` distinct labelled texts, whole (of each language the ones with the smallest hash).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release_memory

#: Buckets of n-grams, a power of two.
DIM = 4096
_SHIFT = np.uint32(33 - DIM.bit_length())
SAMPLE_ROWS = 3000
#: Words of up to CACHED_CHARS characters are kept; the bound changes no result.
CACHE_WORDS = 200_000
CACHED_CHARS = 40
#: So many words' n-grams are hashed at once.
BLOCK_WORDS = 1024
UNKNOWN = "und"
NEW_COLUMNS = ("lang_pred", "score", "ambiguous")
WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters (``str.isalpha``), lower-cased; numerals such as ``½`` or ``Ⅷ`` are none."""
    low = text.lower()
    words = WORD.findall(low)
    return words if all(map(str.isalpha, words)) else LETTERS.findall(low)


def gram_counts(words: list[str]) -> np.ndarray:
    """A text's features: the mean over its words of their shares of n-grams."""
    total = np.zeros(DIM)
    for lo in range(0, len(words), BLOCK_WORDS):
        block = words[lo : lo + BLOCK_WORDS]
        grams = list(_grams(block))
        share = 1 / sum(sizes for _, sizes in grams)
        for buckets, sizes in grams:
            total += np.bincount(buckets, np.repeat(share, sizes), DIM)
    return total / len(words)


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1, 2, 3 the hash buckets of all words' n-grams, word by word, and how many each word has (one at least)."""
    at = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    h = np.zeros(len(at), np.uint32)
    for n in (1, 2, 3):
        h = h[: len(at) - n + 1] * np.uint32(0x9E3779B1) + at[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> _SHIFT)[word[: len(h)] == word[n - 1 :]], sizes - n + 1


def codewords(k: int) -> np.ndarray:
    """k rows of -1/+1 bits: all two-way splits for few classes, else dense codes from a fixed seed."""
    if k <= 6:
        cols = [[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(2 ** (k - 1) - 1)] or [[1] * k]
        return np.array(cols, dtype=np.float32).T
    rng, bits, best, apart = np.random.default_rng(7), 10 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(50):
        code = np.where(rng.random((k, bits)) < 0.5, -1, 1).astype(np.float32)
        d = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min()
        if d > apart and (np.abs(code.sum(0)) < k).all():
            best, apart = code, d
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    bit_weight: np.ndarray
    sharpness: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Words x bits: the mean weight of each word's n-grams."""
        out = np.zeros((len(words), self.code.shape[1]), np.float32)
        for lo in range(0, len(words), BLOCK_WORDS):
            block = words[lo : lo + BLOCK_WORDS]
            count = 0
            for buckets, sizes in _grams(block):
                out[lo : lo + len(block)] += np.add.reduceat(self.weights[buckets], np.cumsum(sizes) - sizes)
                count = count + sizes
            out[lo : lo + len(block)] /= count[:, None]
        return out

    def long_word(self, word: str) -> np.ndarray:
        """The same of one word of any length, by counts of its n-grams."""
        n = sum(np.bincount(buckets, minlength=DIM) for buckets, _ in _grams([word]))
        return (n / n.sum()).astype(np.float32) @ self.weights

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins (rows x bits) -> best class, its probability, its lead over the second."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.bit_weight
        score = -self.sharpness * loss.sum(2)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        lead = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
        return p.argmax(1), p.max(1), lead


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``sample_rows`` distinct texts with a non-null language; None if there are none.

    Every language gives its texts with the smallest hashes, up to a bound that is the same for all: the largest with
    which they are ``sample_rows`` in all, and 1 at least, so that a rare language always takes part. Copies count once.
    All words of the sampled texts count; their features are computed in the tasks.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("o", F.shiftrightunsigned(F.xxhash64("text", "lang"), 24))
    hashes = Scratch(spark, "language-id").put(rows.select("lang", "o", F.shiftrightunsigned("o", 28).cast("int").alias("part")).distinct(), "hashes")
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in hashes.groupBy("lang", "part").count().collect():
        counts.setdefault(r["lang"], []).append((r["part"], r["count"]))
    if not counts:
        return None
    bound = _bound([sum(n for _, n in parts) for parts in counts.values()], sample_rows)
    cuts = spark.createDataFrame([(lang, _reach(parts, bound)) for lang, parts in counts.items()], "lang string, cut int")
    near = hashes.join(F.broadcast(cuts), "lang").filter("part <= cut")
    last = near.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY o)")).filter(F.col("k") <= bound).groupBy("lang").agg(F.max("o").alias("last")).collect()
    last = spark.createDataFrame([tuple(r) for r in last], "lang string, last long")
    sampled = rows.join(F.broadcast(last), "lang").filter("o <= last").select("lang", "o", "text").mapInArrow(_features, "lang string, o long, at binary, share binary")
    seen = sampled.dropDuplicates(["lang", "o"]).orderBy("o", "lang").collect()
    if not seen:
        return None
    langs = sorted({r["lang"] for r in seen})
    code = codewords(len(langs))
    x = np.zeros((len(seen), DIM), dtype=np.float32)
    for k, r in enumerate(seen):
        x[k, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["share"], np.float32)
    target = code[[langs.index(r["lang"]) for r in seen]]
    del seen
    scale = 1 / (x.std(0) + 1e-3)
    x *= scale
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step = 1.0 / (0.25 * float(np.einsum("ij,ij->i", x, x).mean()) + 1)
    vw = np.zeros_like(w)
    for _ in range(150):  # full-batch logistic regression with momentum
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(target)
        vw = 0.9 * vw - step * (x.T @ g + 1e-4 * w)
        w += vw
        b -= step * g.sum(0)
    margins = x @ w + b
    good = np.clip((margins * target > 0).mean(0), 0.5 + 1e-3, 1 - 1e-3)
    bit_weight = np.log(good / (1 - good))
    bit_weight /= bit_weight.sum()
    model = Model(langs, code, (w * scale[:, None]).astype(np.float32), b, bit_weight.astype(np.float32), 1.0)
    own = np.abs(margins).mean() + 1e-6
    model.sharpness = float(max(8.0, 8.0 / min(own, 1.0)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram shares of texts (the third column) that have letters, as the non-zero places and values."""
    for batch in batches:
        take, at, share = [], [], []
        for r in range(batch.num_rows):
            words = words_of(batch.column(2)[r].as_py())
            if words:
                x = gram_counts(words)
                hit = np.flatnonzero(x)
                take.append(r)
                at.append(hit.astype(np.int16).tobytes())
                share.append(x[hit].astype(np.float32).tobytes())
        index = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index).cast(pa.string()), batch.column(1).take(index), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["lang", "o", "at", "share"])
    release_memory()


def _bound(sizes: list[int], total: int) -> int:
    """The largest bound, 1 at least, with which groups of these sizes, cut to it, are ``total`` at most."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if n > share:
            return max(1, share)
        left -= n
    return max(1, *sizes)


def _reach(parts: list[tuple[int, int]], bound: int) -> int:
    """The part of the hashes' range in which the ``bound``-th hash lies, or else the last one."""
    for part, n in sorted(parts):
        bound -= n
        if bound <= 0:
            break
    return part


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", min_lead: float = 0.2) -> DataFrame:
    """The rows with all their columns, and lang_pred, score, ambiguous, from the whole text alone.

    Columns of those three names in the input are replaced. Defined cases: a null text, a text without letters, or no model gives
    ``und``, score 0, not ambiguous; nulls elsewhere are carried along; repeated rows are all judged; a
    word of any length counts.
    """
    docs = docs.drop(*NEW_COLUMNS)
    names = docs.columns
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        cache: dict[str, int] = {}
        table = np.zeros((1024, m.code.shape[1] if m else 1), np.float32)

        def learn(words: set[str]) -> None:
            """Puts new words and their margins into the cache, which starts anew when it is full."""
            nonlocal table
            if len(cache) + len(words) > CACHE_WORDS:
                cache.clear()
            while len(cache) + len(words) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            new, k = list(words), len(cache)
            table[k : k + len(new)] = m.word_margins(new)
            cache.update(zip(new, range(k, k + len(new)), strict=True))

        for batch in batches:
            langs, scores, doubt = [], [], []
            for lo in range(0, batch.num_rows, 1024):
                margins, known = [], []
                for text in batch.column(at).slice(lo, 1024).to_pylist():
                    words = words_of(text) if text and m else []
                    known.append(bool(words))
                    if not words:
                        continue
                    long = [w for w in words if len(w) > CACHED_CHARS]
                    if long:
                        words = [w for w in words if len(w) <= CACHED_CHARS]
                    distinct = set(words)
                    new = {w for w in distinct if w not in cache}
                    if new:
                        learn(new if len(cache) + len(new) <= CACHE_WORDS else distinct)
                    got = list(map(cache.__getitem__, words))
                    total = table[got].sum(0)
                    for w in long:
                        total += m.long_word(w)
                    margins.append(total / (len(got) + len(long)) + m.bias)
                best = iter(zip(*m.decode(np.array(margins)), strict=True)) if margins else iter(())
                for ok in known:
                    b, p, lead = next(best) if ok else (None, 0.0, 1.0)
                    langs.append(m.langs[b] if ok else UNKNOWN)
                    scores.append(float(p))
                    doubt.append(bool(lead < min_lead))
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *NEW_COLUMNS])
        del cache, table
        release_memory()

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(NEW_COLUMNS, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]])
    return docs.mapInArrow(run, schema)


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 1 (never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(1))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the rows outside fold 0 and predict all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = fit(docs.filter(fold(id_col) != 0), lang_col, text_col, sample_rows)
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), *NEW_COLUMNS)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with their columns untouched, whose language is known and not ambiguous; learned as in ``identify``.

    Defined cases: as in ``predict``; where nothing can be learned nothing is rejected; columns named as the prediction's are kept as they are.
    """
    model = fit(docs.filter(fold(id_col) != 0), lang_col, text_col)
    if model is None:
        return docs
    own = [f"c{k}" for k in range(len(docs.columns))]
    judged = predict(docs.toDF(*own), model, own[docs.columns.index(text_col)])
    return judged.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*own).toDF(*docs.columns)
