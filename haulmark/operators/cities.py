"""One spelling per city: keys, canonical names, the change map and typo suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions.text import (
    CITY_ALIASES,
    city_key,
    has_accent,
    simple_form,
    strip_accents,
    title_city,
    uses_alias,
)
from haulmark.sources.star import Star


def city_pairs(star: Star) -> DataFrame:
    """City and state as written in the three tables, with the table of origin."""

    def take(df, city, state):
        return df.select(F.col(city).alias("city"), F.upper(state).alias("state"), F.lit(city).alias("field"))

    pairs = (
        take(star.geo.withColumnsRenamed({"city": "geolocation_city", "state": "geolocation_state"}),
             "geolocation_city", "geolocation_state")
        .unionByName(take(star.customers, "customer_city", "customer_state"))
        .unionByName(take(star.sellers, "seller_city", "seller_state"))
    )
    return pairs.dropna(subset=["city", "state"])


def spelling_counts(pairs: DataFrame, aliases: dict = CITY_ALIASES) -> DataFrame:
    """Rows per spelling. The key is worked out once per distinct spelling, not per row."""
    counted = pairs.groupBy("state", F.col("city").alias("spelling")).agg(F.count("*").alias("n_rows"))
    return counted.withColumn("city_key", city_key("spelling", "state", aliases))


def canonical_city(spellings: DataFrame) -> DataFrame:
    """Name of each key: accented spellings first, then the most frequent, then the greatest."""
    best = F.struct(has_accent("spelling").cast("int").alias("a"), "n_rows", "spelling")
    return spellings.groupBy("state", "city_key").agg(
        title_city(F.max(best)["spelling"]).alias("canonical"), F.sum("n_rows").alias("key_rows")
    )


def city_map(pairs: DataFrame, aliases: dict = CITY_ALIASES) -> DataFrame:
    """Every spelling with its canonical name, the rules that applied and the kind of change."""
    spellings = spelling_counts(pairs, aliases)
    out = spellings.join(canonical_city(spellings).drop("key_rows"), ["state", "city_key"])
    s = F.col("spelling")
    rules = F.array_compact(
        F.array(
            F.when(s.rlike("\\p{Mn}"), "NFC"),
            F.when((s != F.trim(s)) | s.contains("  "), "espacos"),
            F.when(
                s.contains("/") | s.contains("-") | F.endswith(F.lower(s), F.concat(F.lit(" "), F.lower("state"))),
                "sufixo-uf",
            ),
            F.when(uses_alias("spelling", "state", aliases), "alias"),
            F.when(F.lower(strip_accents("spelling")) != F.lower(s), "acento"),
        )
    )
    structural = simple_form("spelling") != simple_form("canonical")
    return out.select(
        "state",
        "spelling",
        "city_key",
        "canonical",
        "n_rows",
        F.when(F.size(rules) > 0, F.array_join(rules, "|")).otherwise("nenhuma").alias("rules"),
        F.when(structural, "estrutural").when(s != F.col("canonical"), "formatacao").otherwise("nenhuma").alias("change"),
    )


def canonical_lookup(mapping: DataFrame) -> DataFrame:
    return mapping.select("state", "spelling", "canonical")


def _deletions(text):
    """The text and every form with one or two characters removed.

    Two texts within edit distance two always share such a form, so an equality join on it
    finds every candidate without comparing all pairs of a state.
    """

    def drop_one(word):
        return F.when(
            F.length(word) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(word)),
                lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    one = F.array_distinct(drop_one(text))
    two = F.flatten(F.transform(one, drop_one))
    return F.array_distinct(F.concat(F.array(text), one, two))


def typo_candidates(mapping: DataFrame, rare_max: int = 3, common_min: int = 100, distance: int = 2) -> DataFrame:
    """Rare names close to a common name of the same state: suggested, never merged."""
    if not 0 <= distance <= 2:
        raise ValueError("the blocking covers edit distances up to two")
    names = mapping.groupBy("state", "canonical").agg(F.sum("n_rows").alias("n_rows"))
    names = names.withColumn("simple", simple_form("canonical"))
    keyed = names.withColumn("form", F.explode(_deletions(F.col("simple"))))
    rare = keyed.filter(F.col("n_rows") <= rare_max).select(
        "state", "form", F.col("canonical").alias("rare_city"), F.col("n_rows").alias("rare_rows"), F.col("simple").alias("a")
    )
    common = keyed.filter(F.col("n_rows") >= common_min).select(
        "state", "form", F.col("canonical").alias("likely_city"), F.col("n_rows").alias("likely_rows"), F.col("simple").alias("b")
    )
    pairs = rare.join(common, ["state", "form"]).drop("form").distinct()
    return (
        pairs.withColumn("edit_distance", F.levenshtein("a", "b", distance))
        .filter("a <> b AND edit_distance > 0")
        .select("state", "rare_city", "rare_rows", "likely_city", "likely_rows", "edit_distance")
    )


def missing_in_domain(df: DataFrame, domain: DataFrame, col: str) -> DataFrame:
    """Distinct values without an entry in the domain table."""
    return df.filter(F.col(col).isNotNull()).select(col).distinct().join(domain.select(col), col, "left_anti")
