"""A pipeline from raw documents to a mixed training set.

Each stage takes the rows that its predecessor kept, with any further columns, whatever
their names (but `copy`, which the last stage adds). An empty table stays empty; repeated
rows and ties are handled as each stage says; texts are read whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstats.llm import decontamination, language_id, mixing, near_dedup, secret_scan
from rillstats.llm.common import fresh, read_table, small_side, stored
from rillstats.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised: null and empty texts, texts without a
    letter, and those that cost more than plain bytes in every language learnt from the rows
    with a language. Rows with a null id are judged like others and repeated rows alike."""
    ship(spark)
    model = language_id.learnt(docs.where(~language_id.held_out()))
    return language_id.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies of each other the one with the smallest id stays; of
    rows with one id and text one. Rows with a null id, null and empty texts stay."""
    ship(spark)
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, with all rows of their ids. Rows with
    a null id stay: they can't be named; so do null and empty texts."""
    ship(spark)
    (named,) = fresh(docs, "leaked_id")
    found = stored(decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(named)), "contaminated")
    return docs.join(small_side(found), F.col("doc_id") == F.col(named), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; all rows stay, null texts as null. Where docs has n_chars it
    follows the text."""
    ship(spark)
    return secret_scan.redacted_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, numbered by `copy` from 1. Each row
    is taken as planned for it, also with a null or a repeated id; a null source is a source;
    null and empty texts have no words and are never taken."""
    ship(spark)
    taken = mixing.mixed(docs, own=True).where("copies > 0")
    return taken.select(*(F.col("own").getField(c).alias(c) for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained statistics and components can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
