"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import (
    chat,
    decontaminate,
    divergence,
    exact,
    html,
    kneser_ney,
    licenses,
    near,
    packing,
    periodic,
    repeats,
    sharding,
    toxicity,
)

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker,
         coalesce(text, '') AS said, coalesce(turn // 256, 4611686018427387904) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), met AS (
  SELECT t.*, s.perspective,
         CASE WHEN lower(t.speaker) = 'system' THEN 'system' WHEN t.speaker = s.perspective THEN 'assistant'
              ELSE 'user name=' || translate(replace(t.speaker, '<|', '<|\'), chr(13) || chr(10), '  ') END AS who
  FROM turns t
  JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE lower(speaker) <> 'system') s USING (conv_id)
), segments AS (
  SELECT *, '<|im_start|>' || who || chr(10) AS head,
         '<|im_start|>' || who || chr(10) || replace(said, '<|', '<|\') || '<|im_end|>' || chr(10) AS segment
  FROM met
), placed AS (
  SELECT *, sum(length(segment)) OVER w - length(segment) AS pos, row_number() OVER w AS k
  FROM segments
  WINDOW w AS (PARTITION BY conv_id, perspective, p ORDER BY turn NULLS LAST, speaker, said ROWS UNBOUNDED PRECEDING)
), parts AS (
  SELECT conv_id, perspective, p, count(*) AS n_turns, string_agg(segment, '' ORDER BY k) AS text,
         coalesce(string_agg(CASE WHEN who = 'assistant'
                  THEN (pos + length(head))::BIGINT || '-' || (pos + length(segment) - 1)::BIGINT END, ',' ORDER BY k), '') AS mask
  FROM placed GROUP BY conv_id, perspective, p
)
SELECT conv_id, perspective, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY p) - 1 AS part,
       n_turns, text, mask
FROM parts
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT name, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), h AS (SELECT doc_id, s, k, name FROM dw JOIN iw USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, name FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c)::HUGEINT + 5)) // (any_value(t.n) + 5 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang) t USING (lang)
  GROUP BY lang, term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation from every speaker's side; the mask as text, such as `25-60,91-140`."""
    rows = chat.perspectives(table(spark, sf, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return rows.withColumn("mask", F.array_join(spans, ","))


def op2_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.report(table(spark, sf, "pages"))


def op3_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.report(table(spark, sf, "documents"), 8)


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    return kneser_ney.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.notices(table(spark, sf, "documents"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.report(spark, f"{sf}/documents.parquet")


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("spans", "items")


def op8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), ids=False)


def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.report(table(spark, sf, "documents"))


def op10_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.report(table(spark, sf, "documents"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


def op13_periodic(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.report(table(spark, sf, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat": op1_chat,
        "op2_main_text": op2_main_text,
        "op3_shards": op3_shards,
        "op4_quality": op4_quality,
        "op5_licenses": op5_licenses,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_decontaminate": op7_decontaminate,
        "op8_pack": op8_pack,
        "op9_near_dedup": op9_near_dedup,
        "op10_repeats": op10_repeats,
        "op11_toxicity": op11_toxicity,
        "op12_divergence": op12_divergence,
        "op13_periodic": op13_periodic,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": OP1,
        "op6_exact_dedup": OP6,
        "op7_decontaminate": OP7,
        "op12_divergence": OP12,
    }
