"""The star of order tables: explicit schemas, a reader, and an adapter from TPC-H-like tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.session import use_utc


@dataclass
class Star:
    """One DataFrame per table; keys and columns as in ``COLUMNS``."""

    orders: DataFrame
    items: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    payments: DataFrame
    geo: DataFrame
    reviews: DataFrame
    translation: DataFrame


# File stem of each table, and per column the name in the file, ours, the type.
FILES = {
    "orders": "olist_orders_dataset",
    "items": "olist_order_items_dataset",
    "customers": "olist_customers_dataset",
    "sellers": "olist_sellers_dataset",
    "products": "olist_products_dataset",
    "payments": "olist_order_payments_dataset",
    "geo": "olist_geolocation_dataset",
    "reviews": "olist_order_reviews_dataset",
    "translation": "product_category_name_translation",
}
COLUMNS = {
    "orders": [
        ("order_id", "order_id", "string"),
        ("customer_id", "customer_id", "string"),
        ("order_status", "order_status", "string"),
        ("order_purchase_timestamp", "purchase_ts", "timestamp"),
        ("order_approved_at", "approved_ts", "timestamp"),
        ("order_delivered_carrier_date", "carrier_ts", "timestamp"),
        ("order_delivered_customer_date", "delivered_ts", "timestamp"),
        ("order_estimated_delivery_date", "promised_ts", "timestamp"),
    ],
    "items": [
        ("order_id", "order_id", "string"),
        ("order_item_id", "order_item_id", "int"),
        ("product_id", "product_id", "string"),
        ("seller_id", "seller_id", "string"),
        ("shipping_limit_date", "shipping_limit_ts", "timestamp"),
        ("price", "price", "double"),
        ("freight_value", "freight_value", "double"),
    ],
    "customers": [
        ("customer_id", "customer_id", "string"),
        ("customer_unique_id", "customer_unique_id", "string"),
        ("customer_zip_code_prefix", "zip_prefix", "zip"),
        ("customer_city", "customer_city", "string"),
        ("customer_state", "customer_state", "string"),
    ],
    "sellers": [
        ("seller_id", "seller_id", "string"),
        ("seller_zip_code_prefix", "zip_prefix", "zip"),
        ("seller_city", "seller_city", "string"),
        ("seller_state", "seller_state", "string"),
    ],
    "products": [
        ("product_id", "product_id", "string"),
        ("product_category_name", "category", "string"),
        ("product_name_lenght", "name_length", "double"),
        ("product_description_lenght", "description_length", "double"),
        ("product_photos_qty", "photos", "double"),
        ("product_weight_g", "weight_g", "double"),
        ("product_length_cm", "length_cm", "double"),
        ("product_height_cm", "height_cm", "double"),
        ("product_width_cm", "width_cm", "double"),
    ],
    "payments": [
        ("order_id", "order_id", "string"),
        ("payment_sequential", "payment_sequential", "int"),
        ("payment_type", "payment_type", "string"),
        ("payment_installments", "installments", "int"),
        ("payment_value", "payment_value", "double"),
    ],
    "geo": [
        ("geolocation_zip_code_prefix", "zip_prefix", "zip"),
        ("geolocation_lat", "lat", "double"),
        ("geolocation_lng", "lng", "double"),
        ("geolocation_city", "city", "string"),
        ("geolocation_state", "state", "string"),
    ],
    "reviews": [
        ("review_id", "review_id", "string"),
        ("order_id", "order_id", "string"),
        ("review_score", "review_score", "int"),
        ("review_comment_title", "title", "string"),
        ("review_comment_message", "message", "string"),
        ("review_creation_date", "created_ts", "timestamp"),
        ("review_answer_timestamp", "answered_ts", "timestamp"),
    ],
    "translation": [
        ("product_category_name", "category", "string"),
        ("product_category_name_english", "category_english", "string"),
    ],
}


def check_sources(spark: SparkSession, folder: str, required=tuple(FILES.values()), suffix: str = ".csv") -> None:
    """Fail before any work when a required file or directory is missing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(conf)
    missing = [n for n in required if not fs.exists(jvm.org.apache.hadoop.fs.Path(base, n + suffix))]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(n + suffix for n in missing)}")


def read_star(spark: SparkSession, folder: str, fmt: str = "csv") -> Star:
    """Read the nine tables with fixed schemas.

    Every CSV column is read as text and converted: bad timestamps and numbers become null,
    ZIP prefixes stay strings padded to five digits. Parquet keeps its own types.
    """
    use_utc(spark)
    suffix = ".csv" if fmt == "csv" else ".parquet"
    check_sources(spark, folder, suffix=suffix)
    tables = {}
    for name, columns in COLUMNS.items():
        path = f"{folder}/{FILES[name]}{suffix}"
        schema = ", ".join(f"`{source}` string" for source, _, _ in columns)
        if fmt == "csv":
            # Review texts hold line breaks, so that one file cannot be split into lines.
            reader = spark.read.schema(schema).option("header", True).option("escape", '"')
            raw = reader.option("multiLine", name == "reviews").csv(path)
        else:
            raw = spark.read.parquet(path)
        tables[name] = raw.select(*[_convert(source, target, kind) for source, target, kind in columns])
    return Star(**tables)


def _convert(source: str, target: str, kind: str):
    col = F.col(source)
    if kind == "timestamp":
        return F.try_to_timestamp(col.cast("string")).alias(target)
    if kind == "zip":
        text = F.trim(col.cast("string"))
        return F.when(text != "", F.lpad(text, 5, "0")).alias(target)
    if kind in ("int", "double"):
        return col.try_cast(kind).alias(target)
    return col.cast("string").alias(target)


def write_star(star: Star, folder: str, fmt: str = "parquet") -> None:
    """Store the star as Parquet or CSV under the file names the reader expects."""
    for name, columns in COLUMNS.items():
        df = getattr(star, name)
        names = {target: source for source, target, _ in columns}
        known = [c for c in df.columns if c in names]
        absent = [F.lit(None).cast("string").alias(s) for s, t, _ in columns if t not in df.columns]
        out = df.select(*[F.col(c).alias(names[c]) for c in known], *absent).write.mode("errorifexists")
        if fmt == "csv":
            out = out.option("header", True).option("escape", '"')
        out.format(fmt).save(f"{folder}/{FILES[name]}.{fmt}")


def _hours(ts, n):
    """Shift a timestamp by whole hours."""
    return F.timestamp_add("HOUR", n.cast("int"), ts)


class AdaptedStar:
    """The star derived from TPC-H-like Parquet tables by fixed formulas.

    The formulas plant every defect the curation rules look for; the same ones are written in
    SQL for the comparison, so both sides see the same rows. A table is planned on first use.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = use_utc(spark), folder

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    @property
    def _nation(self) -> DataFrame:
        return self._table("nation")

    @cached_property
    def _buyers(self) -> DataFrame:
        return self._table("customer").join(self._nation, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def orders(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        status = (
            F.when(k % 160 == 0, "canceled").when(k % 40 == 7, "shipped").otherwise("delivered")
        )
        base = self._table("orders").select(
            k.alias("k"),
            c.alias("c"),
            F.col("o_orderpriority").alias("priority"),
            status.alias("st"),
            _hours(F.col("o_orderdate").cast("timestamp"), k % 24).alias("buy"),
        )
        k, c, st, buy = F.col("k"), F.col("c"), F.col("st"), F.col("buy")
        base = base.withColumns(
            {"app": _hours(buy, c % 36), "car": _hours(buy, c % 36 + ((k * 7) % 61 - 1) * 3)}
        )
        car = F.col("car")
        return base.select(
            k.alias("order_id"),
            c.alias("customer_id"),
            st.alias("order_status"),
            buy.alias("purchase_ts"),
            F.when(k % 97 != 0, F.col("app")).alias("approved_ts"),
            F.when(~((st != "delivered") & (k % 2 == 1)), car).alias("carrier_ts"),
            F.when((st != "delivered") | (k % 200 == 3), F.lit(None).cast("timestamp"))
            .when(k % 500 == 11, _hours(car, F.lit(-24)))
            .when(k % 900 == 13, _hours(car, F.lit(24 * 120)))
            .otherwise(_hours(car, 24 * ((k * 13) % 29) + k % 10))
            .alias("delivered_ts"),
            _hours(F.date_trunc("day", buy), 24 * (20 + c % 10)).alias("promised_ts"),
            "priority",
        )

    @cached_property
    def items(self) -> DataFrame:
        ok = F.col("l_orderkey")
        once = self._table("lineitem").select(
            ok.alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").cast("timestamp").alias("shipping_limit_ts"),
            F.col("l_extendedprice").alias("price"),
            F.round(F.col("l_extendedprice") * F.col("l_tax") * F.when(ok % 701 == 0, 90).otherwise(1) + 0.00003, 2).alias(
                "freight_value"
            ),
        )
        # One pass over lineitem: the doubled rows come from an explode, not from a second scan.
        copies = F.when(F.col("order_id") % 220 == 0, F.array(F.lit(0), F.lit(100))).otherwise(F.array(F.lit(0)))
        return once.withColumn("shift", F.explode(copies)).select(
            "order_id",
            (F.col("order_item_id") + F.col("shift")).alias("order_item_id"),
            "product_id",
            "seller_id",
            "shipping_limit_ts",
            "price",
            "freight_value",
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self._table("supplier")
            .join(self._nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.lpad((F.col("s_suppkey") % 50).cast("string"), 5, "0").alias("zip_prefix"),
                F.concat(F.lit("N"), "s_nationkey").alias("seller_state"),
                F.col("n_name").alias("seller_city"),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        ck = F.col("c_custkey")
        city = (
            F.when(ck % 40 == 3, F.concat(F.lower("n_name"), F.lit(" - n"), F.col("c_nationkey")))
            .when(ck % 40 == 9, F.lower("n_name"))
            .otherwise(F.col("n_name"))
        )
        return self._buyers.select(
            ck.alias("customer_id"),
            F.lpad((10000 + ck % 300).cast("string"), 5, "0").alias("zip_prefix"),
            F.concat(F.lit("N"), "c_nationkey").alias("customer_state"),
            city.alias("customer_city"),
        )

    @cached_property
    def products(self) -> DataFrame:
        pk, size = F.col("p_partkey"), F.col("p_size")
        return self._table("part").select(
            pk.alias("product_id"),
            F.col("p_type").alias("category"),
            F.when(pk % 211 == 0, None)
            .when(pk % 307 == 0, 0.0)
            .when(pk % 401 == 0, 35000.0)
            .otherwise(size * 150.0)
            .alias("weight_g"),
            (size + 10.0).alias("length_cm"),
            (size + 5.0).alias("height_cm"),
            (size + 8.0).alias("width_cm"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        due = self.items.groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("v"))
        oid, v, pr = F.col("order_id"), F.col("v"), F.col("priority")
        kind = (
            F.when(oid % 1500 == 0, "not_defined")
            .when(pr.startswith("1"), "boleto")
            .when(pr.startswith("2"), "voucher")
            .when(pr.startswith("3"), "debit_card")
            .otherwise("credit_card")
        )
        first = F.struct(
            F.lit(1).alias("payment_sequential"),
            kind.alias("payment_type"),
            F.when(oid % 1500 == 0, 0.0).when(oid % 300 == 7, v + 5.0).when(oid % 5 == 0, v / 2).otherwise(v).alias(
                "payment_value"
            ),
        )
        second = F.struct(
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            (v - v / 2).alias("payment_value"),
        )
        split = (oid % 5 == 0) & (oid % 1500 != 0) & (oid % 300 != 7)
        return (
            due.join(self.orders.select("order_id", "priority"), "order_id")
            .select("order_id", F.inline(F.when(split, F.array(first, second)).otherwise(F.array(first))))
            .withColumn("installments", (F.col("order_id") % 4).cast("int"))
        )

    @cached_property
    def geo(self) -> DataFrame:
        ck = F.col("c_custkey")
        places = (
            self.sellers.select("zip_prefix", F.col("seller_state").alias("state"), F.col("seller_city").alias("city"))
            .union(
                self._buyers.select(
                    F.lpad((10000 + ck % 300).cast("string"), 5, "0"), F.concat(F.lit("N"), "c_nationkey"), "n_name"
                )
            )
            .distinct()
            .withColumn("z", F.col("zip_prefix").cast("int"))
            .filter("z % 60 <> 5")
        )
        z = F.col("z")
        lat, lng = -33.0 + ((z * 37) % 380) / 10.0, -73.0 + ((z * 53) % 380) / 10.0

        def point(a, b):
            return F.struct(a.alias("lat"), b.alias("lng"))

        points = F.array_compact(
            F.array(
                *[point(lat + j * 0.01, lng + j * 0.02) for j in range(3)],
                F.when(z % 4 == 0, point(lat, lng)),
                F.when(z % 90 == 0, point(F.lit(41.0), F.lit(-8.0))),
            )
        )
        return places.select("zip_prefix", F.inline(points), "city", "state")

    @cached_property
    def reviews(self) -> DataFrame:
        oid = F.col("order_id")
        created = _hours(F.col("promised_ts"), (oid % 7) * 24)
        return self.orders.filter("order_id % 50 <> 1").select(
            F.explode(F.when(oid % 60 == 2, F.array(oid, oid + 1)).otherwise(F.array(oid))).alias("review_id"),
            "order_id",
            (1 + oid % 5).cast("int").alias("review_score"),
            created.alias("created_ts"),
            _hours(created, (oid * 11) % 90).alias("answered_ts"),
        )

    @cached_property
    def translation(self) -> DataFrame:
        return (
            self._table("part")
            .select(F.col("p_type").alias("category"))
            .distinct()
            .filter("category NOT LIKE 'S%'")
            .withColumn("category_english", F.lower("category"))
        )


def adapt_star(spark: SparkSession, folder: str) -> AdaptedStar:
    return AdaptedStar(spark, folder)
