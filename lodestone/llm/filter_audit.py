"""How filters overlap: what each removes, repeats and costs, for every order in which they may be applied.

A document's failures are one bit mask: four tests of its own text and one of the whole table, whether a smaller id has an identical
text. That one comes from partition refinement. Documents are split by their length in code points, then by the hash of one block
of text after the other (each block four times as long as the one before); after each split classes of one document are dropped,
and a class whose text is used up leaves the loop. The full texts of what survives are grouped, equal texts by their content and not by
their hash, and all but the smallest id of each group are marked. Masks are then counted per part, and all orders read those counts.

Classes that hold more than a thousandth of all documents are at most a thousand and are broadcast; the rest are joined by shuffles, so
no class meets in one task. Counts and least ids are summed before every shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .periodic_runs import words_of

FIRST_BLOCK, GROWTH = 1024, 4
#: A class with more than this share of the rows is heavy: there are at most 1 / HEAVY of them.
HEAVY = 1 / 1000
DUPLICATE = "E"


def text_filters() -> dict[str, tuple[str, ...]]:
    """The letters of the filters on a document's own text, with what each one says."""
    return {"A": "under 200 words", "B": "under half of the words distinct", "C": "over 2 % capitals", "D": "holds #$%&*|"}


def _failures(text: Column, words: Column) -> dict[str, Column]:
    """Which tests a text fails; the words come as an array."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _blocks(text: Column, most: int) -> Column:
    """The hashes of the blocks of a text; block k begins where k - 1 ends, the last one may be short."""
    hashes, at, size = [], 1, FIRST_BLOCK
    while at <= most:
        hashes.append(F.when(F.length(text) >= at, F.xxhash64(F.substring(text, at, size))))
        at, size = at + size, size * GROWTH
    return F.array_compact(F.array(*hashes)) if hashes else F.array().cast("array<bigint>")


def _in_classes(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose class has another row. Heavy classes go to every task, at most 1 / HEAVY of them; the others are spread by key."""
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1")
    heavy = F.broadcast(sizes.filter(F.col("n") > HEAVY * total).select("cls"))
    light = sizes.filter(F.col("n") <= HEAVY * total).select("cls")
    return rows.join(heavy, "cls", "left_semi").unionByName(rows.join(heavy, "cls", "left_anti").join(light, "cls", "left_semi")).select(*rows.columns)


def refine(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, final): the documents that share length and all block hashes with another one; ``slim`` has doc_id, len, blocks, final.

    ``final``, a hash of the whole text, only tells rows of one id apart.
    """
    total = slim.count()
    left = scratch.put(_in_classes(slim.withColumn("cls", F.col("len").cast("long")), total), "length")
    done, k = [], 0
    while not left.isEmpty():
        done.append(left.filter(F.size("blocks") <= k).select("doc_id", "final"))
        longer = left.filter(F.size("blocks") > k).withColumn("cls", F.xxhash64("cls", F.get("blocks", F.lit(k))))
        left = scratch.put(_in_classes(longer, total), f"block{k}")
        k += 1
    return reduce(DataFrame.unionByName, done) if done else left.select("doc_id", "final")


def duplicate_ids(docs: DataFrame, slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, dup): the classes in which a document has the text of a smaller id; docs has doc_id, text."""
    survivors = scratch.put(refine(slim.filter("doc_id IS NOT NULL"), scratch).distinct(), "survivors")
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("final"))
    # survivors grow with the table: one shuffle of the texts at every size, never a broadcast
    whole = texts.join(survivors.hint("merge"), ["doc_id", "final"], "left_semi")
    # the grouping compares whole texts; every task sends a text once
    least = whole.groupBy("final", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "final")
    gone = survivors.join(least, ["doc_id", "final"], "left_anti")
    return gone.groupBy("doc_id").agg(F.collect_set("final").alias("dup"))


def failure_masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, mask, good, toxic) per document: bit k of mask is the k-th filter, the last one the duplicates."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    most = rows.agg(F.max(F.length("text"))).first()[0] or 0
    tests = _failures(F.col("text"), F.col("words"))
    mask = reduce(lambda a, b: a + b, [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests.values())])
    text = F.col("text")
    slim = rows.withColumn("words", words_of(text)).select("doc_id", "part", mask.alias("own"), F.length(text).alias("len"), _blocks(text, most).alias("blocks"), F.xxhash64(text).alias("final"))
    slim = scratch.put(slim, "slim")
    gone = duplicate_ids(rows.select("doc_id", "text"), slim.select("doc_id", "len", "blocks", "final"), scratch)
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = slim.filter("doc_id IS NOT NULL").select("doc_id", "part", "own", "final").join(gone, "doc_id", "left").join(marks, "doc_id", "left")
    fails = F.coalesce(F.array_contains("dup", F.col("final")), F.lit(False))
    out = known.select("doc_id", "part", (F.col("own") + F.when(fails, 1 << len(tests)).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unknown = slim.filter("doc_id IS NULL").select("doc_id", "part", F.col("own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return out.unionByName(unknown)


def over_orders(masks: DataFrame, letters: str) -> DataFrame:
    """The counts of every order and step from (part, mask, good, toxic); ``letters`` names the bits from the lowest."""
    n = len(letters)
    cell = lambda value, m: F.sum(F.when(F.col("mask") == m, value).otherwise(0)).cast("long")
    columns = {"rows": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    cells = masks.groupBy("part").agg(*[F.array(*[cell(v, m) for m in range(1 << n)]).alias(f"_{c}") for c, v in columns.items()])
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = lambda word: reduce(lambda a, b: a + b, [F.when(F.instr(word, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(letters)])
    own, earlier = F.substr("filter_order", F.col("step"), F.lit(1)), F.substr("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("_own", bits(own)).withColumn("_earlier", bits(earlier))
    fails, before = (lambda m: m.bitwiseAND(F.col("_own")) != 0), (lambda m: m.bitwiseAND(F.col("_earlier")) != 0)

    def total(column: str, holds, weight=None) -> Column:
        at = F.sequence(F.lit(0), F.lit((1 << n) - 1))
        value = lambda m: F.get(column, m) if weight is None else F.get(column, m) * weight(m)
        return F.aggregate(at, F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m), value(m)).otherwise(F.lit(0).cast("long")))

    count = 1
    for k in range(2, n + 1):
        count *= k
    # in so many of the orders a filter comes first among the failed ones
    share = lambda m: (F.lit(count) / F.bit_count(m)).cast("long")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("_rows", lambda m: ~fails(m) & ~before(m)).alias("kept"), total("_rows", lambda m: fails(m) & ~before(m)).alias("removed"),
        total("_rows", lambda m: fails(m) & before(m)).alias("redundant"), total("_rows", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("_good", lambda m: fails(m) & ~before(m)).alias("good_lost"), total("_toxic", lambda m: fails(m) & ~before(m)).alias("toxic_lost"),
        total("_rows", fails, share).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Defined cases: a null text counts as empty, a null part as the empty string; a row with a null id is no duplicate, makes none and
    has no labels; rows of the same id and text are no duplicates of each other; null labels are no labels, of several for one id any 1 counts; other
    columns are ignored; an empty table gives an empty result. Texts of any length are compared whole.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    return over_orders(failure_masks(docs, labels, scratch, id_col, text_col, part_col), "".join(text_filters()) + DUPLICATE)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT w.doc_id, part,
        (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask,
        coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic
      FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INT AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
p AS (SELECT part, filter_order, step::INT AS step, own, earlier FROM (SELECT DISTINCT part FROM d), s)
SELECT p.part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM p JOIN c ON c.part = p.part GROUP BY p.part, filter_order, step"""
