"""One query per operator, over the whole intended table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillpath.llm.common import read_table


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.simhash import near_dedup

    return near_dedup(read_table(spark, folder, "documents"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.bpe import digests, encode

    return digests(encode(read_table(spark, folder, "documents")))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document before and after the stated revision of its text."""
    from tillpath.llm.token_counts import apply_edits, build_trees, revision_of

    trees = build_trees(read_table(spark, folder, "documents"))
    return apply_edits(trees.withColumn("edits", revision_of())).select(
        "doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_encoded_chars"
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.positive_unlabelled import classify

    return classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.token_files import read_index, scratch_folder, write

    files = scratch_folder(spark)
    write(read_table(spark, folder, "documents"), files)
    return read_index(spark, files)


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.secrets import scan

    return scan(read_table(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.packing import pack

    return pack(read_table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.sharding import shard

    return shard(read_table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every document once one in ten has got a stretch that repeats."""
    from tillpath.llm.periodic_runs import periodic_runs, planted

    return periodic_runs(read_table(spark, folder, "documents"), planted, texts=False).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
        "n_words", "n_kept_words"
    )


def op12_cross_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.cross_alignment import cross_alignment

    return cross_alignment(read_table(spark, folder, "documents"), texts=False)


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from tillpath.llm.language_mixture import language_id

    return language_id(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_bpe, op3_token_counts, op4_quality_classifier, op5_exact_dedup, op6_token_files, op7_secret_scans, op8_best_fit_packing, op9_quality_rules, op10_sharding, op11_periodic_runs, op12_cross_alignment, op13_language_id)}
