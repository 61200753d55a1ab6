"""Corpus preparation: documents through five of the corpus operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet in the shared folder
and rereads as the next stage's documents.  All but the last keep the columns
of ``documents``.  Rows are dropped one by one under a staged row number, so
repeated and NULL doc_ids are decided like all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import documents, stage
from framewise.llm.decontaminate import contaminated_rows
from framewise.llm.jaccard import Rule, jaccard_components
from framewise.llm.mixing import mixed_counts
from framewise.llm.queries import remainder
from framewise.llm.secrets import redacted, train as train_secrets
from framewise.llm.toxicity import score_column, train as train_toxicity

TOXIC = 0.3
NEAR = Rule(n=5, num=80, den=100)       # five words, a similarity of 0.8 or more


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is at least ``TOXIC``."""
    allowed = F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(True))
    scorer = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed)
    score = "_" * (1 + max(map(len, docs.columns)))         # a name that no column has
    return docs.withColumn(score, score_column(scorer, F.col("text"))).where(F.col(score) < TOXIC).drop(score)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents staged with a number of each row, and its column's name."""
    row = "_" * (1 + max(map(len, docs.columns)))           # a name that no column has
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of rows whose five-word shingles have a
    similarity of 0.8 or more: that of least doc_id (NULL last)."""
    rows, row = numbered(docs)
    found = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias(row), "component_id")
    kept = found.join(rows.select(row, F.col("doc_id").cast("long").alias("doc_id")), row).groupBy("component_id") \
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", row)).alias("least")).select(F.col("least")[row].alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a run of benchmark words."""
    rows, row = numbered(docs)
    found = contaminated_rows(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    return rows.join(found, row, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; texts stay otherwise as they are."""
    out = docs.withColumn("text", redacted(F.col("text"), train_secrets(docs)))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix what is left to the target weights."""
    return mixed_counts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]
# A trained score decides the first stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
