"""Versioned output folders with a manifest, and reading them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.hashing import row_number_hash, table_hash
from haulmark.functions.numbers import parse_bool
from haulmark.operators.curation import CONTRACT, FLAG_CONTRACT

# Rules a curated version states.
RULES = [
    "no row is removed from the main table; the quarantine is an extract",
    "a weight that is not positive becomes null, the original is kept",
    "city spellings collapse by key; the canonical one is the most frequent accented spelling",
    "exact duplicates of points are dropped before the ZIP centroid is taken",
    "points outside the country box are kept apart and leave the centroid",
    "typing errors in city names are suggested, never merged",
    "near-duplicate items are marked, never removed",
    "orders without a seller get a branch of their own",
    "honest lateness divides by all active orders",
    "the declared state is compared with the ZIP state and never overwritten",
    "implausible values are marked and never corrected",
]


def write_version(tables: dict[str, DataFrame], folder: str, version: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """One Parquet table per name; a version that exists is never overwritten."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{folder}/{version}/{name}")


def write_shipments(df: DataFrame, folder: str) -> None:
    """Shipments between jobs, grouped by month so that a time slice reads only its files."""
    by_month = df.withColumn("year_month", F.date_format("purchase_ts", "yyyy-MM"))
    by_month.repartition("year_month", F.pmod(F.xxhash64("order_id"), F.lit(16))).write.mode("errorifexists").partitionBy(
        "year_month"
    ).parquet(folder)


def read_curated(spark: SparkSession, folder: str, version: str, table: str = "entregas_curado", fmt: str = "parquet") -> DataFrame:
    """A curated table of one version. The CSV form is semicolon-separated text with typed dates and flags."""
    path = f"{folder}/{version}/{table}"
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).option("sep", ";").csv(path if path.endswith(".csv") else path + ".csv")
    dates = [c for c in raw.columns if c.startswith("dt_")]
    flags = [c for c in ("ativo", "atraso_mensuravel", "vencido_sem_registo", "qa_quarentena", *FLAG_CONTRACT.values()) if c in raw.columns]
    three = [c for c in ("atrasado", "atraso_honesto") if c in raw.columns]
    numbers = [CONTRACT[c] for c in ("weight_g", "weight_g_original", "goods_value", "freight_value", "paid_value", "lead_days", "days_vs_promise") if CONTRACT[c] in raw.columns]
    whole = [c for c in (CONTRACT["n_items"], "qa_flags_total") if c in raw.columns]
    cols = {c: F.try_to_timestamp(F.col(c)) for c in dates} | {c: F.col(c).try_cast("long") for c in whole} | {c: parse_bool(c) for c in flags}
    cols |= {c: F.when(F.trim(c) != "", parse_bool(c)) for c in three} | {c: F.col(c).try_cast("double") for c in numbers}
    return raw.withColumns(cols)


def build_manifest(version: str, sources: dict[str, DataFrame], outputs: dict[str, DataFrame], params: dict, window: DataFrame | None = None) -> DataFrame:
    """Long manifest: kind, name, key and value of sources, outputs, parameters, rules and window.

    Tables are described by rows, columns and an order-independent content hash.
    """
    spark = next(iter((outputs or sources).values())).sparkSession
    fixed = [("version", "version", "", version)]
    fixed += [("param", k, "", json.dumps(v, ensure_ascii=False)) for k, v in params.items()]
    fixed += [("rule", str(i + 1), "", r) for i, r in enumerate(RULES)]
    out = spark.createDataFrame(fixed, "kind string, name string, key string, value string")
    for kind, tables in (("source", sources), ("output", outputs)):
        for name, df in tables.items():
            fields = {"rows": F.col("rows").cast("string"), "columns": F.lit(str(len(df.columns))), "hash": F.concat_ws(":", "hash_sum", "hash_xor")}
            pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
            out = out.unionByName(table_hash(df).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.inline(pairs)))
    if window is not None:
        bounds = window.agg(F.min("purchase_ts").alias("a"), F.max("purchase_ts").alias("b"))
        for key, c in (("start", "a"), ("end", "b")):
            out = out.unionByName(bounds.select(F.lit("window").alias("kind"), F.lit("purchase").alias("name"), F.lit(key).alias("key"), F.col(c).cast("date").cast("string").alias("value")))
    return out


def provenance_report(manifest: DataFrame) -> DataFrame:
    """One row per table or parameter with what is known about it."""
    return manifest.groupBy("kind", "name").agg(
        F.max(F.when(F.col("key") == "rows", F.col("value").cast("long"))).alias("rows"),
        F.max(F.when(F.col("key") == "columns", F.col("value").cast("int"))).alias("columns"),
        F.substring(F.max(F.when(F.col("key") == "hash", F.col("value"))), 1, 12).alias("hash"),
        F.max(F.when(F.col("key").isin("", "start", "end"), F.col("value"))).alias("value"),
    )


_FILE = ["file_path", "file_size", "file_modification_time"]


def file_hashes(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Rows and order-free hashes of each file of a Parquet table; files that ``known`` has are not read again.

    A file is the same when its path, size and time of change are. Only names of changed files come to the driver.
    """
    table = spark.read.parquet(path)
    files = table.select(*[F.col(f"_metadata.{c}").alias(c) for c in _FILE]).distinct()
    changed = files if known is None else files.join(known, _FILE, "left_anti")
    names = [r["file_path"] for r in changed.select("file_path").collect()]
    kept = None if known is None else known.join(files, _FILE, "left_semi")
    if not names:
        return kept if kept is not None else spark.createDataFrame([], "file_path string, file_size long, file_modification_time timestamp, rows long, hash_sum decimal(38,0), hash_xor long")
    own = row_number_hash(table.columns)
    read = spark.read.schema(table.schema).parquet(*names).select(*[F.col(f"_metadata.{c}").alias(c) for c in _FILE], own.alias("_h"))
    made = read.groupBy(*_FILE).agg(
        F.count("*").alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("_h").alias("hash_xor")
    )
    return made if kept is None else kept.unionByName(made)


def hash_of_files(files: DataFrame) -> DataFrame:
    """The table's hash from those of its files, as ``table_hash`` has it: sums and exclusive-ors add up."""
    return files.agg(F.sum("rows").alias("rows"), F.sum("hash_sum").cast("decimal(38,0)").cast("string").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"))


class MetricStore:
    """Reports of a run in long form, one folder per run and section; writing a section again replaces it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def record(self, run: str, section: str, report: DataFrame, keys: list[str]) -> None:
        rows = metrics_long(report, section, keys).drop("section")
        rows.write.mode("overwrite").parquet(f"{self.folder}/run={run}/section={section}")

    def read(self, run: str) -> DataFrame:
        schema = "key string, metric string, value double, run string, section string"
        return self.spark.read.schema(schema).parquet(self.folder).filter(F.col("run") == run).select("section", "key", "metric", "value")


def metrics_long(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """Any report as (section, key, metric, value) rows."""
    values = [c for c, kind in df.dtypes if c not in keys and kind in ("int", "bigint", "double", "boolean")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(pairs))
