"""Licence scan: TF-IDF cosine of statements to templates, then inheritance from the nearest directory.

Built-in functions and joins only. The vocabulary is that of the templates, so the table of document
frequencies has a fixed number of rows; a word outside it counts as one no document has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import stored

#: How licences are named in headers and licence files, under their SPDX identifiers.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, Unlicense."),
]
#: A line is looked at when it has one of these; every template has.
CUE = "licen[sc]e|copyright|public domain|spdx"
SEPARATORS = "[^a-z0-9.+-]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.6
NAMES = [name for name, _ in TEMPLATES]


def template_words() -> list[tuple[str, str, int]]:
    out: dict[tuple[str, str], int] = {}
    for name, text in TEMPLATES:
        for word in re.split(SEPARATORS, text.lower()):
            if word := word.strip(".-+"):
                out[name, word] = out.get((name, word), 0) + 1
    return [(name, word, n) for (name, word), n in sorted(out.items())]


def template_rows() -> str:
    return ", ".join(f"('{name}', '{word}', {n})" for name, word, n in template_words())


def lowered(text: str) -> Column:
    return F.translate(F.col(text), UPPER, LOWER)


def words_of(text: str) -> Column:
    """Words of a text: letters, digits and inner dots, signs at the ends cut off."""
    return F.filter(F.transform(F.split(F.col(text), SEPARATORS), lambda w: F.trim(w, F.lit(".+-"))), lambda w: w != "")


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {template_rows()} AS t(license, word, n)")


def weights(docs: DataFrame) -> DataFrame:
    """``word, idf`` for the words of the templates, over all documents with a text; and one row, word null, for any other."""
    spark = docs.sparkSession
    known = sorted({w for _, w, _ in template_words()})
    here = F.array_intersect(words_of("low"), F.array(*[F.lit(w) for w in known]))
    counted = docs.filter("text IS NOT NULL").select(lowered("text").alias("low")).select(
        F.explode(F.array_append(here, F.lit(None).cast("string"))).alias("word")
    ).groupBy("word").agg(F.count("*").alias("df"))
    counted = stored(counted)
    texts = counted.filter("word IS NULL").select("df").scalar()
    every = vocabulary(spark).select("word").distinct().unionAll(spark.sql("SELECT CAST(NULL AS STRING) AS word"))
    found = every.join(counted.filter("word IS NOT NULL"), "word", "left")
    total = F.coalesce(texts, F.lit(0))
    # The row without a word stands for words outside the vocabulary, which are taken as found nowhere.
    return found.select("word", (F.log((total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))


def statements(docs: DataFrame) -> DataFrame:
    """``doc_id, path, unit, words``: lines with a cue, such a line with the next, and whole texts that have one."""
    rows = docs.withColumn("low", lowered("text")).filter(F.col("low").rlike(CUE))
    rows = rows.withColumn("lines", F.split("low", "\n"))
    at = F.sequence(F.lit(1), F.size("lines"))
    pick = F.transform(at, lambda i: F.struct((i * 2).alias("unit"), F.element_at("lines", i).alias("said"), F.concat_ws(" ", F.element_at("lines", i), F.try_element_at("lines", i + 1)).alias("two")))
    cued = F.filter(pick, lambda s: s["said"].rlike(CUE))
    units = F.concat(
        F.transform(cued, lambda s: F.struct(s["unit"].alias("unit"), s["said"].alias("said"))),
        F.transform(cued, lambda s: F.struct((s["unit"] + 1).alias("unit"), s["two"].alias("said"))),
        F.array(F.struct(F.lit(0).alias("unit"), F.col("low").alias("said"))),
    )
    said = rows.select("doc_id", "path", F.explode(units).alias("u")).select("doc_id", "path", "u.unit", "u.said")
    return said.select("doc_id", "path", "unit", words_of("said").alias("words"))


def own_licenses(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, path, own_license, own_score`` of documents that state a licence."""
    idf = stored(weights(docs))
    other = idf.filter("word IS NULL").select("idf").scalar()
    # Templates and their words are constants of this module: the broadcast has a few hundred rows.
    template = vocabulary(docs.sparkSession).join(idf, "word").withColumn("w", F.col("n") * F.col("idf")).drop("idf", "n")
    norm = template.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template = template.join(norm, "license").select("word", "license", (F.col("w") / F.col("norm")).alias("w"))
    terms = statements(docs).select("doc_id", "path", "unit", F.explode("words").alias("word"))
    counted = terms.groupBy("doc_id", "path", "unit", "word").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(idf.filter("word IS NOT NULL")), "word", "left")
    weighed = weighed.withColumn("x", F.col("tf") * F.coalesce("idf", other))
    spread = template.groupBy("word").agg(*[F.sum(F.when(F.col("license") == name, F.col("w"))).alias(f"w{i}") for i, name in enumerate(NAMES)])
    unit = weighed.join(F.broadcast(spread), "word", "left").groupBy("doc_id", "path", "unit").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"),
        *[F.coalesce(F.sum(F.col("x") * F.col(f"w{i}")), F.lit(0.0)).alias(f"d{i}") for i in range(len(NAMES))],
    )
    scores = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("length"), 6).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("license")) for i, name in enumerate(NAMES)])
    best = unit.select("doc_id", "path", F.array_max(scores).alias("best")).groupBy("doc_id", "path").agg(F.max("best").alias("best"))
    return best.filter(F.col("best.score") >= least).select("doc_id", "path", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"))


def directory(path: str) -> Column:
    return F.regexp_replace(F.col(path), "/[^/]*$", "")


def scan_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, path, own_license, own_score, license, from_dir``.

    ``files`` has ``doc_id, path, text``. A file that states a licence has it. Any other takes
    that of its nearest directory, its own first, in which a file states one; the first such file by path and
    id speaks for the directory. Null and empty texts state nothing and can inherit; a null path has no
    directory. A file is compared line by line, by two adjoining lines and as a whole; ties go to the first
    identifier. Rows that repeat one id and path are one file. An empty table gives no rows.
    """
    docs = files.select("doc_id", "path", "text")
    own = stored(own_licenses(docs, least))
    speaks = own.filter("path IS NOT NULL").groupBy(directory("path").alias("dir")).agg(
        F.min(F.struct("path", "doc_id", "own_license"))["own_license"].alias("dir_license")
    )
    names = docs.select("doc_id", "path").distinct().withColumn("dir", directory("path"))
    # Ancestors are looked up once for each directory, not for each file.
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct((F.size(parts) - n).alias("steps"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    dirs = names.filter("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(up).alias("up")).select("dir", "up.*")
    nearest = dirs.join(speaks.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.min(F.struct("steps", "above", "dir_license")).alias("near"))
    nearest = nearest.select("dir", F.col("near.above").alias("above"), F.col("near.dir_license").alias("dir_license"))
    out = names.join(nearest, "dir", "left").join(own.withColumnRenamed("path", "_p").withColumnRenamed("doc_id", "_d"), F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_p").eqNullSafe(F.col("path")), "left")
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("above")).alias("from_dir"),
    )
