"""A training corpus from ``documents``: quality filter, near-dedup, repeated passages, source mix, packing.

Every stage takes the documents that the one before it kept, with the columns of ``documents``
(others are dropped), and its verdict decides which documents, or which of their words, go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.bytenet import score_quality
from haulmark.llm.common import bucket_of, stored
from haulmark.llm.mixing import mix_sources
from haulmark.llm.narrow import maybe_in
from haulmark.llm.neardup import near_duplicates
from haulmark.llm.packing import pack_documents
from haulmark.llm.passages import cut_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A learned filter and a random draw stand in the way of SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for good ones; it learns from two thirds of the labels.

    Null and empty texts are judged like any other (an empty text); repeated rows fare alike; null
    labels are not learned from; an empty table gives none. Other columns are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select(*COLUMNS), labels, bucket_of("doc_id", 3) != 1, COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Rows that repeat an id and its text are one document. A null id stays where its group has no other.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))
    found = stored(near_duplicates(rows, more=("_key",)))
    own = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("_key")]
    gone = found.filter(~F.col("kept")).select(*own).distinct()
    again = found.select(*own).groupBy("_none", "_id", "_key").count().filter("count > 1").drop("count")
    touched = stored(gone.withColumn("_go", F.lit(True)).unionByName(again.withColumn("_go", F.lit(False))).groupBy("_none", "_id", "_key").agg(F.max("_go").alias("_go")))
    near, far = maybe_in(rows.select(*COLUMNS, *own), touched, "_none", "_id", "_key")
    near = near.join(touched.filter("_go"), ["_none", "_id", "_key"], "left_anti").dropDuplicates(["_none", "_id", "_key"])
    return far.select(*COLUMNS).unionByName(near.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document of smaller id has too.

    A text that loses words has the rest joined by single spaces; one that loses all of them goes.
    """
    cut = cut_passages(docs.select(*COLUMNS), COLUMNS, with_text=True)
    cut = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", F.coalesce("kept_text", "text"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: some not at all, some up to three times.

    A text without words is never taken, as it adds none. Null sources are one source. Rows of one id are
    documents of their own; rows equal in all columns share what was taken of them. An empty table gives none.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_key"))
    taken = mix_sources(rows, key=F.col("_key"))
    own = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("_key")]
    picks = taken.withColumnRenamed("key", "_key").select(*own, "copies").groupBy("_none", "_id", "_key").agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")
    ).filter("_copies > 0")
    met = rows.select(*COLUMNS, *own).join(picks, ["_none", "_id", "_key"])
    # Rows that are equal in all columns share what was taken of them.
    once = met.filter("_rows = 1").unionByName(met.filter("_rows > 1").dropDuplicates(["_none", "_id", "_key"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the bin, its length, and which words of which document lie where in it.

    Texts without words have no row. Rows of one id, and copies that the mix made, are packed each on
    its own. An empty table gives none.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("mix", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
