"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, filter_audit, fingerprints, jaccard_join, language_id, licenses, main_text, packing, periodic_runs, segmentation, sharding, token_counts, url_filter,
)
from .common import documents


def _piece_model() -> str:
    import public_tokenizers as files

    return files.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL: by the longest rule, else by trees fitted on the URLs that rules label. Null URLs have an empty host and path."""
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, a row per piece. Null texts are the end id alone."""
    return packing.pack(documents(spark, sf_dir), **packing.public_files())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in all documents, a row per notice with its words and coverage. Null texts have none."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text, compared without ASCII white space. Null texts count as empty."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and the least id of its near-copy component. Empty texts link with nothing."""
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every document. Null texts have none."""
    return token_counts.token_counts(documents(spark, sf_dir), vocab_path=_piece_model())


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every document with their inclusion scores, seeded by its id."""
    return segmentation.sample_segmentations(documents(spark, sf_dir), _piece_model(), key_cols=("doc_id",))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the tail of the next one, by descending id; null ids last."""
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, with gapless slots. Null texts have a size of 1."""
    out = sharding.kd_shards(documents(spark, sf_dir), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by codewords fitted on labelled documents that are not held out. Texts without letters are und."""
    return language_id.identify(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over all documents, per source."""
    return filter_audit.filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, a tenth of them with a planted tail, as counts and digests."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted_repeats(documents(spark, sf_dir))))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_url_filter, op2_packing, op3_license_scan, op4_exact_dedup, op5_jaccard_join, op6_token_counts, op7_sentencepiece, op8_fingerprints, op9_sharding, op10_language_id,
        op11_filter_audit, op12_periodic_runs, op13_html_extraction, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op5_jaccard_join": jaccard_join.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL}
