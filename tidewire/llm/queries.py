"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, hard_negatives, html_extract, jaccard_join, licenses, line_dedup, packing, personal_data, quality_model, quality_rules, tokens, vector_codes, warc
from tidewire.llm.common import table
from tidewire.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_line_dedup")
def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).withColumnsRenamed({"n_chunks_": "n_chunks", "n_removed_": "n_removed"})


@query("op3_quality_model")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("weak_score_").alias("weak_score"), F.col("score_").alias("score"), F.col("kept_").alias("kept"))


@query("op4_jaccard_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT row, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM (SELECT row, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT row, i, dw.l, item FROM dw JOIN bw USING (g, l)),
n AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + l)) AS p FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)"""


@query("op5_decontaminate", OP5_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def _op7_sql() -> str:
    rules, features = quality_rules.Rules(), quality_rules.FEATURES
    step = {f.name: f"CASE WHEN {f.below} > 0 THEN ({f.above} * {f.steps}) // {f.below} ELSE 0 END" for f in features}
    values = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS feature, {s} AS bin FROM c WHERE NOT base_failed" for n, s in step.items())
    slack = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.slack}" for f in features) + " END"
    inside = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {step[f.name]} <= high" + (
        f" AND {step[f.name]} >= low" if f.two_sided else "") for f in features) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 3)) AS p
      FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1) GROUP BY row),
c0 AS (SELECT row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper FROM w LEFT JOIN r USING (row)),
c AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM c0),
v AS ({values}),
s AS (SELECT 0 AS level, lang, source, feature, bin, count(*) AS n FROM v GROUP BY ALL UNION ALL
      SELECT 1, lang, '', feature, bin, count(*) FROM v GROUP BY ALL UNION ALL SELECT 2, '', '', feature, bin, count(*) FROM v GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, feature) AS total,
             sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY bin) AS upto FROM s),
q AS (SELECT level, lang, source, feature, any_value(total) AS total, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1,
             min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3 FROM u GROUP BY level, lang, source, feature),
f AS (SELECT *, q1 - ({rules.fence} * (q3 - q1) + {slack}) AS low, q3 + {rules.fence} * (q3 - q1) + {slack} AS high
      FROM q WHERE total >= {rules.min_group} OR level = 2),
p AS (SELECT row, min(level) AS level FROM c JOIN f ON level = 2 OR f.lang = c.lang AND (level = 1 OR f.source = c.source) GROUP BY row),
k AS (SELECT row, bool_and({inside}) AS inside FROM c JOIN p USING (row) JOIN f ON f.level = p.level AND (p.level = 2 OR f.lang = c.lang)
      AND (p.level > 0 OR f.source = c.source) GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, TRUE) AS kept
FROM c LEFT JOIN k USING (row)"""


@query("op6_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_quality_rules", _op7_sql())
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op9_html_extract")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op10_personal_data")
def private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query("op8_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS row FROM pages),
n AS (SELECT *, CAST(strlen(html) AS BIGINT) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, row) AS place,
             max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n < 1000 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 1000 AND place > 1 THEN head END AS refers_to FROM n"""


@query("op11_warc_archives", OP11_SQL)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _op12_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS w
      FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, p, w[len(w) // {parts} * p + 1:len(w) // {parts} * (p + 1)] AS w FROM v, range({parts}) AS t(p)),
f AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS e FROM v),
c0 AS MATERIALIZED (SELECT p, e, w AS c FROM x JOIN f USING (row) WHERE e < {entries})"""]
    nearest = "SELECT row, p, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := e)) AS m FROM x JOIN {} USING (p) GROUP BY row, p"
    for n in range(vector_codes.ROUNDS):
        steps.append(f"""a{n} AS MATERIALIZED ({nearest.format(f"c{n}")}),
s{n} AS (SELECT p, m.e AS e, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (row, p), (SELECT unnest(range(1, len(w) // {parts} + 1)) AS i FROM (SELECT w FROM v LIMIT 1)) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(t.c, o.c) AS c FROM c{n} o LEFT JOIN
      (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY p, e) t USING (p, e))""")
    last = f"c{vector_codes.ROUNDS}"
    steps.append(f"""a AS MATERIALIZED ({nearest.format(last)}),
r AS (SELECT row, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM {last})""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (row), h"""


@query("op12_vector_codes", _op12_sql())
def coded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
      list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {hard_negatives.SCALE})) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row AS a, a.vec_id AS anchor_id, a.label = x.label AS same, x.row AS row, x.vec_id AS vec_id, CAST(list_dot_product(a.q, x.q) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.row <> x.row),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.a, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
