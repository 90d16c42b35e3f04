"""A corpus pipeline of four of the operators: language ID, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, documents, free_name, strip_ascii_space
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.language_id import keep_identified
from lodestone.llm.packing import pack, public_files


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters and ambiguous ones go.

    Defined cases: a null or empty text and one without letters goes; repeated rows are judged alike; very long texts are judged whole; nulls
    in other columns are carried along, and columns of any name stay as they are; without any labelled text nothing goes.
    """
    return keep_identified(docs)


def _unique_ids(rows: DataFrame) -> bool:
    ids = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.countDistinct("doc_id").alias("distinct")).first()
    return ids["n"] == ids["named"] == ids["distinct"]


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Where ids are unique the dropped ids decide; otherwise rows are matched on id, length and text hash,
    and one of the repeated rows stays.
    """
    judged = Scratch(spark, "exact-stage").put(exact_dedup(docs), "judged")
    if _unique_ids(judged):
        return docs.join(judged.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    text, name, copy = F.coalesce("text", F.lit("")), free_name(docs, "_key"), free_name(docs, "_copy")
    key = F.struct(F.col("doc_id").alias("id"), F.length(text).alias("n"), F.sha2(strip_ascii_space(text).cast("binary"), 256).alias("sha"))
    same_text = judged.filter("kept").select(F.col("doc_id").alias("kid"), F.col("text_sha256").alias("ksha")).distinct().alias("same")
    # of repeated ids the row with the most code points stays in its group, as in the operator
    marked = docs.withColumn(name, key).alias("row")
    hit = marked.join(same_text, F.col(f"row.{name}.id").eqNullSafe(F.col("same.kid")) & (F.col(f"row.{name}.sha") == F.col("same.ksha")), "left_semi")
    numbered = hit.withColumn(copy, F.expr(f"row_number() OVER (PARTITION BY {name}.id, {name}.sha ORDER BY {name}.n DESC)"))
    return numbered.filter(F.col(copy) == 1).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id.

    Where ids are unique the dropped ids decide; otherwise every row goes by id and text hash: of a group's
    rows the one with the least id (rows without one come last), then the least hash stays, once. Rows without shingles all stay.
    """
    scratch = Scratch(spark, "near-stage")
    if _unique_ids(docs):
        judged = scratch.put(jaccard_components(docs), "judged")
        gone = scratch.put(judged.filter("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    name = free_name(docs, "_row")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    marked = docs.withColumn(name, row)
    judged = scratch.put(jaccard_components(marked.select(F.col(name).alias("row"), "text"), id_col="row"), "judged")
    grouped = judged.filter("n_shingles > 0")
    gone = scratch.put(grouped.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    repeated = grouped.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).count().filter("count > 1").select(name)
    repeated = scratch.put(repeated, "repeated")
    same = lambda other: marked[name].eqNullSafe(other[name])  # noqa: E731  a row without an id has a null inside
    left = marked.join(gone, same(gone), "left_anti")
    once = left.join(repeated, left[name].eqNullSafe(repeated[name]), "left_semi").dropDuplicates([name])
    return left.join(repeated, left[name].eqNullSafe(repeated[name]), "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    Defined cases: a null or empty text is its end id alone; null ids and repeated rows are packed like others; a very long text is cut
    over as many sequences as it takes; an empty table gives no piece; other columns are ignored.
    """
    return pack(docs, **public_files())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("packing", packing_stage),
]
#: A trained model decides in the first stage, so SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
