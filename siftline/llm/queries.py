"""The ten operators as queries over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cdc, chat, decontaminate, langid, linededup, mixing, ngram_lm, quality, simhash, stages, url_filter

URL_RULES = [
    ("example.net", "block"),
    ("example.net/en", "allow"),
    ("blog.thththe.example.net", "allow"),
    ("example.org", "allow"),
    ("example.org/de", "block"),
    ("example.org/de/1", "allow"),
    ("example.com/fr", "block"),
    ("example.com/es", "block"),
    ("therin.example.com", "block"),
    ("tracker.example.com", "block"),
    ("example.com", "allow"),
    ("example.com", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "pattern string, kind string")
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), rules)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"), chat.chatml)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), stages.TARGETS).drop("k")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.score(docs, ngram_lm.train(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents")).select("doc_id", "quality", "keep")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "words", "first_doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filter, op2_simhash, op3_chat_format, op4_language_id, op5_decontaminate, op6_line_dedup, op7_source_mix, op8_lm_score, op9_quality_rules, op10_substring_dedup, pipeline)
    return {f.__name__: f for f in every}


_RULES = ", ".join(f"('{p}', '{k}')" for p, k in URL_RULES)

OP1_SQL = rf"""
WITH parsed AS (
  SELECT page_id, url,
    regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.+$', '') AS host,
    list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segments
  FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM parsed WHERE host <> ''),
suffixes AS (SELECT page_id, labels, segments, unnest(range(1, len(labels) + 1)) AS n FROM labelled),
keys AS (SELECT page_id, n, labels, segments, unnest(range(0, len(segments) + 1)) AS m FROM suffixes),
named AS (
  SELECT page_id, n, m, array_to_string(labels[len(labels) - n + 1:], '.') || CASE WHEN m > 0 THEN '/' || array_to_string(segments[1:m], '/') ELSE '' END AS rule FROM keys),
rules AS (SELECT pattern AS rule, bool_or(kind = 'block') AS is_block FROM (VALUES {_RULES}) v(pattern, kind) GROUP BY pattern),
best AS (
  SELECT page_id, rule, is_block FROM named JOIN rules USING (rule)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n + m DESC, n DESC) = 1)
SELECT p.page_id, p.url, CASE WHEN b.rule IS NULL THEN 'none' WHEN b.is_block THEN 'block' ELSE 'allow' END AS decision, b.rule AS rule, NOT coalesce(b.is_block, false) AS keep
FROM pages p LEFT JOIN best b ON p.page_id = b.page_id
"""

OP3_SQL = """
WITH rendered AS (
  SELECT conv_id, turn, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS span, text FROM conversations),
placed AS (
  SELECT *, CAST(sum(length(span)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM rendered WHERE conv_id IS NOT NULL)
SELECT conv_id, turn, role, stop - length(span) AS "start", stop AS "end", span, 'ok' AS status FROM placed
"""

OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM benchmark),
grams AS (SELECT item_id, least(5, len(w)) AS width, len(w) - least(5, len(w)) + 1 AS length, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS g FROM bw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, width, length, g FROM grams),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM items),
places AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS pos FROM dw, widths WHERE len(w) >= width),
hits AS (SELECT p.doc_id, p.pos, i.item_id, i.g, i.length FROM (SELECT doc_id, pos, width, array_to_string(w[pos:pos + width - 1], ' ') AS g FROM places) p JOIN items i ON p.g = i.g AND p.width = i.width),
spans AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.g) AS held FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.length GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(held) AS held FROM spans GROUP BY ALL)
SELECT doc_id, item_id, round(held / size, 6) AS containment FROM best JOIN sizes USING (item_id) WHERE held >= greatest(1, ceil(round(size * 0.6, 9)))
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op3_chat_format": OP3_SQL, "op5_decontaminate": OP5_SQL}
