"""Every operator of this package as a query over a whole given table, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercalith.llm.common import sf_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.token_store import store_digest

    return store_digest(sf_table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.bpe import encode_documents

    return encode_documents(sf_table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.simhash import near_duplicates

    return near_duplicates(sf_table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.quality import quality

    return quality(sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "labels")).drop("text")


# Sizes, targets by sharing the excess again (at most one round for each source, 40 allow 40
# sources to fill up one after the other), and one ordered sum for each source.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * sum(size) AS lim,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
share(n, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT n + 1, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(lim) FROM s WHERE lim <= level * w), 0))
                / nullif((SELECT sum(w) FROM s WHERE lim > level * w), 0)
  FROM share WHERE n < 40 AND level IS NOT NULL),
t AS (
  SELECT source, source_size,
         CAST(least(lim, (SELECT max(level) FROM share) * w) AS DOUBLE) AS target FROM s),
o AS (
  SELECT doc_id, d.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)
         + CASE WHEN b + size / 2 <= target - floor(target / source_size) * source_size
           THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM o
"""


@query("op8_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.mixing import mix

    return mix(sf_table(spark, sf_dir, "documents"))


# Every window with the smallest document it starts in, and the words that no repeat covers.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws) - 12)) AS i)),
low AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, unnest(generate_series(i, i + 12)) AS j FROM win JOIN low USING (s) WHERE doc_id > first),
gone AS (SELECT doc_id, list_distinct(list(j)) AS js FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         CASE WHEN js IS NULL THEN ws
              ELSE list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))),
                                              lambda z: NOT list_contains(js, z[2])), lambda z: z[1]) END,
         ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op5_substrings", SUBSTRING_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mercalith.llm.substrings import remove_repeats

    cut = remove_repeats(sf_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mercalith.llm.extraction import extract

    texts = extract(sf_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g'))
                + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op7_chat", CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.chat import format_and_read, table_turns

    said = r"\### Assistant: </turn> ok"
    rows = sf_table(spark, sf_dir, "conversations")
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return format_and_read(table_turns(rows.select("conv_id", "turn", "role", "text").union(own)))


@query("op10_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.vectors import near_vectors

    return near_vectors(sf_table(spark, sf_dir, "embeddings"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.language import identify

    return identify(sf_table(spark, sf_dir, "documents"))


# Windows of items and of documents as arrays of words, joined by their text for each length.
LEAK_SQL = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item_windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
  FROM d, ks, LATERAL (SELECT unnest(generate_series(1, len(ws) - k + 1)) AS i)),
hits AS (SELECT r, i, w.k, item FROM doc_windows w JOIN item_windows v ON w.k = v.k AND w.s = v.s),
found AS (SELECT r, count(DISTINCT j) AS n_hit
          FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (r) LEFT JOIN named USING (r)
"""


@query("op11_decontamination", LEAK_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mercalith.llm.decontaminate import report

    found = report(sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op12_conversations")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.repair import damaged, report

    rows = sf_table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


# CRC-32 by its table over the bytes of `doc_id:run`; words that share all letters but one, or all but
# an added one; forms followed to the last.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS uses
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, uses, xor(list_reduce(flatten(list_transform(string_split(doc || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM runs, crc),
v AS (
  SELECT word, CAST(sum(uses) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                    ELSE run END AS word, uses FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(uses) >= 5),
holes AS (
  SELECT word, left(word, i - 1) || '_' || substr(word, i + 1) AS pattern, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM v, LATERAL (SELECT unnest(generate_series(1, length(word))) AS i)),
inserted AS (SELECT DISTINCT h.word AS l, v.word AS s FROM holes h JOIN v ON v.word = h.rest),
near AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b USING (pattern) WHERE a.word <> b.word
  UNION ALL SELECT l, s FROM inserted UNION ALL SELECT s, l FROM inserted),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS top, max(v.n) AS top_n
  FROM near JOIN v ON v.word = near.other GROUP BY near.word),
formed AS (
  SELECT word, n, CASE WHEN top_n >= 5 * n THEN top END AS form, coalesce(n_near, 0) AS n_near,
         CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk(word, step) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.step WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, step AS root FROM walk JOIN formed ON formed.word = step WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query("op13_spelling", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercalith.llm.spelling import variants

    return variants(sf_table(spark, sf_dir, "documents"))
