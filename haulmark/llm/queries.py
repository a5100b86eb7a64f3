"""Registered queries of the text operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import bucket_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_mix_sources")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.mixing import mix_sources

    return mix_sources(table(spark, folder, "documents")).drop("key")


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.rules import apply_rules

    return apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))[0]


@query("op4_byte_network")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.bytenet import score_quality

    held_out = bucket_of("doc_id", 3) == 1
    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.toxicity import score_toxicity

    held_out = bucket_of("doc_id", 5) == 0
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.langid import identify_languages

    held_out = bucket_of("doc_id", 4) == 2
    found = identify_languages(table(spark, folder, "documents"), ~held_out, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query(
    "op9_repeated_passages",
    rf"""
    WITH w AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS ws FROM documents),
    win AS (
      SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    lo AS (SELECT k, min(doc_id) AS lowest FROM win GROUP BY k),
    hit AS (SELECT win.doc_id, win.i FROM win JOIN lo USING (k) WHERE win.doc_id > lo.lowest),
    gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(50) t(j)),
    word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
    kept AS (
      SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
      FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.passages import cut_passages

    return cut_passages(table(spark, folder, "documents"), ["doc_id"]).drop("kept_text")


@query(
    "op10_near_duplicates",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
      FROM documents),
    sh AS (
      SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


@query("op8_packed_sequences")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@query("op1_nearest_vectors")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, folder, "embeddings"), every=20)


def _license_sql() -> str:
    from haulmark.llm import licenses as m

    tokens = "[trim(w, '.+-') FOR w IN string_split_regex({0}, '" + m.SEPARATORS + "') IF trim(w, '.+-') <> '']"
    order = ", ".join(f"('{name}', {i})" for i, (name, _) in enumerate(m.TEMPLATES))
    return f"""
    WITH v(license, word, n) AS (VALUES {m.template_rows()}), o(license, place) AS (VALUES {order}),
    f AS (SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || '/' || doc_id AS path,
                 translate(text, '{m.UPPER}', '{m.LOWER}') AS low FROM documents),
    df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tokens.format('low')})) AS word FROM f) GROUP BY word),
    total AS (SELECT count(low) AS n FROM f),
    idf AS (SELECT DISTINCT v.word, ln((total.n + 1) / (coalesce(df.df, 0) + 1)) + 1 AS idf FROM v CROSS JOIN total LEFT JOIN df USING (word)),
    t0 AS (SELECT license, word, n * idf AS w FROM v JOIN idf USING (word)),
    t AS (SELECT license, word, w / sqrt(sum(w * w) OVER (PARTITION BY license)) AS w FROM t0),
    l AS (SELECT doc_id, path, string_split(low, chr(10)) AS ls, low FROM f WHERE regexp_matches(low, '{m.CUE}')),
    spots AS (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
    cue AS (SELECT *, ls[i] AS said FROM spots WHERE regexp_matches(ls[i], '{m.CUE}')),
    u AS (SELECT doc_id, path, 2 * i AS unit, said FROM cue
          UNION ALL SELECT doc_id, path, 2 * i + 1, said || coalesce(' ' || ls[i + 1], '') FROM cue
          UNION ALL SELECT doc_id, path, 0, low FROM l),
    tf AS (SELECT doc_id, path, unit, word, count(*) AS tf FROM (SELECT doc_id, path, unit, unnest({tokens.format('said')}) AS word FROM u) GROUP BY ALL),
    x AS (SELECT tf.*, tf * coalesce(idf.idf, ln(total.n + 1) + 1) AS x FROM tf CROSS JOIN total LEFT JOIN idf USING (word)),
    len AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS length FROM x GROUP BY ALL),
    dot AS (SELECT doc_id, path, unit, license, sum(x * w) AS dot FROM x JOIN t USING (word) GROUP BY ALL),
    best AS (SELECT doc_id, path, license AS own_license, round(dot / length, 6) AS own_score FROM dot JOIN len USING (doc_id, unit) JOIN o USING (license)
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / length, 6) DESC, place) = 1),
    own AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM best WHERE own_score >= {m.LEAST}),
    speaks AS (SELECT dir, arg_min(own_license, path) AS dir_license FROM own GROUP BY dir),
    d AS (SELECT doc_id, path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM f),
    up AS (SELECT doc_id, k, array_to_string(parts[1:k], '/') AS dir FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)),
    near AS (SELECT doc_id, arg_max(dir, k) AS dir, arg_max(dir_license, k) AS dir_license FROM up JOIN speaks USING (dir) GROUP BY doc_id)
    SELECT d.doc_id, d.path, own.own_license, own.own_score, coalesce(own.own_license, near.dir_license) AS license,
           CASE WHEN own.own_license IS NULL THEN near.dir END AS from_dir
    FROM d LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
    """


@query("op5_licenses", _license_sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no paths: source and hundreds of ids stand for directories."""
    from haulmark.llm.licenses import scan_licenses

    docs = table(spark, folder, "documents")
    step = lambda n: F.expr(f"CAST(doc_id DIV {n} AS STRING)")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), step(1000), step(50), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")))


from haulmark.llm import build_queries as _build_queries  # noqa: E402, F401  (it registers its queries here)
