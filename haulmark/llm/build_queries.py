"""Registered queries of whitening, spelling variants and token files, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm.queries import query, table
from haulmark.session import work_folder


@query("op11_whitened_embeddings")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.whitening import by_component, whiten

    return by_component(whiten(table(spark, folder, "embeddings"), ["vec_id"]), ["vec_id"])


#: crc32 (IEEE) has no function in this SQL: its table is built from the polynomial, then folded over bytes.
_CRC_TABLE = """
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))
"""
#: Letters above ASCII are U+00C0 to U+00FF: two bytes, 195 and the code point less 64.
_CRC = """
  xor(4294967295, list_reduce(
    flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)),
    lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295))
"""


@query(
    "op12_spelling_variants",
    rf"""
    WITH RECURSIVE tab AS ({_CRC_TABLE}),
    run AS (
      SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE len(r) >= 7 GROUP BY ALL),
    h AS (SELECT r, n, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM run, tab),
    v AS (
      SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % len(r))::INT) || substr(r, (h % len(r))::INT + 2) ELSE r END AS word, n FROM h)
      WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS k FROM (SELECT *, unnest(range(0, len(word))) AS i FROM v)),
    pair AS (
      SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, k) WHERE a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.k = b.word
      UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.k = b.word),
    near AS (
      SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
    told AS (
      SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
             CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN near USING (word)),
    walk AS (
      SELECT word, word AS spot, 0 AS steps FROM told
      UNION ALL SELECT walk.word, told.form, steps + 1 FROM walk JOIN told ON told.word = walk.spot WHERE told.form IS NOT NULL),
    root AS (SELECT word, arg_max(spot, steps) AS root FROM walk GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM told JOIN root USING (word)
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from haulmark.llm.variants import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))


@query("op13_token_files")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from haulmark.llm.tokenfiles import id_checksums, read_tokens, write_tokens

    path = f"{work_folder(spark)}.tokens"
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return id_checksums(read_tokens(spark, path))
