"""From raw documents to packed training sequences: judge, thin lines, join near copies, take test items out, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and rereads it as the next one's docs.
All but the last keep the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import materialize, numbered, shared_dir, table
from lanewise.llm.decontamination import decontaminate
from lanewise.llm.line_dedup import dedup_lines
from lanewise.llm.ngram_join import row_components
from lanewise.llm.packing import pack
from lanewise.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 4 rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines (operator 3) the first stays; n_chars follows the text. A document that had text and has none left goes."""
    thin = dedup_lines(docs)
    return thin.filter("n_dropped = 0 OR trim(text) <> ''").withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of operator 9 one row stays, that of smallest doc_id: of rows that share it, or if none has an id, one of them.

    Documents without words link with nothing and stay.
    """
    docs, number = numbered(docs, "near-docs")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(number).alias("row"), F.col("text").cast("string").alias("text"))
    found = materialize(row_components(text).select("doc_id", "row", "component"), "near-components")
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    stay = first.select(F.col("x.row").alias("_stay")).union(found.filter("component IS NULL").select("row"))
    return docs.join(stay, F.col(number) == F.col("_stay"), "left_semi").drop(number)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item (operator 6) go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row per piece, with its token ids."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("packing", packing)]

# The classifier, the fuzzy lines and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder, one after another, each stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/lanewise-corpus/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
