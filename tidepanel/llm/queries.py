"""Registered queries of the operators, each over its whole table, and SQL partners where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm import collocations, decontaminate, html_wrappers, language_id, mixing, pii, quality, secrets, shingle_join, toxicity, turn_repair, url_rules, vector_search
from tidepanel.llm.common import held_out, in_small_batches

# The URL rules (host, path, verdict), the number of grades, and the phrases reported of a language.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
GRADES = 3
TOP_PHRASES = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of poor quality, 1 of good quality but toxic, 2 of good quality; grade 1 or better is kept."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    model = quality.train(documents, labels.select("doc_id", grade.alias("grade")), GRADES)
    found = quality.selected(documents, model, GRADES)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixture(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])
    return drawn.withColumn("weight", F.round("weight", 7))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_search.nearest(vectors, asked, 20)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extracted(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.scored(documents.select("doc_id", "text"), toxicity.train(documents, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, totals = collocations.mined(table(spark, sf_dir, "documents"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = phrases.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= TOP_PHRASES)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language_id.predicted(documents, language_id.train(documents))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets, op2_ngram_jaccard, op3_quality, op4_decontamination, op5_url_filters,
        op6_mixing, op7_nearest, op8_html, op9_toxicity, op10_pii, op11_collocations, op12_language_id, op13_turn_repair,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g
  FROM w
), post AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM post a JOIN post b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g
"""

_OP4 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))
), m AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
item AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_OP5 = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
f AS (
  SELECT page_id, host, path, h || p AS rule, v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id, host, path)
"""

_OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), e AS (SELECT *, ('0x' || substr(k, 1, {len(f"{mixing.BLOCKS - 1:x}")}))::INT AS block FROM d),
t AS (SELECT source, sum(n_tokens)::DOUBLE AS t FROM e GROUP BY source),
p AS (SELECT t / (SELECT sum(t) FROM t) AS p FROM t WHERE t > 0),
goal AS (SELECT {mixing.ENTROPY} * ln(count(*)) AS h FROM p),
spread(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) >= (SELECT h FROM goal) AS ok FROM spread WHERE i < {mixing.STEPS})
), a0 AS (
  SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= (SELECT h FROM goal) THEN 1.0::DOUBLE ELSE (SELECT lo FROM spread WHERE i = {mixing.STEPS}) END AS a
), again(i, lo, hi) AS (
  SELECT 0, a, 1.0::DOUBLE FROM a0
  UNION ALL
  SELECT i + 1, CASE WHEN many THEN (lo + hi) / 2 ELSE lo END, CASE WHEN many THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) FROM p) > {mixing.EPOCHS} AS many FROM again WHERE i < {mixing.STEPS})
), a AS (
  SELECT CASE WHEN (SELECT max(pow(p, a) / p) / sum(pow(p, a)) FROM p) <= {mixing.EPOCHS} THEN a ELSE (SELECT hi FROM again WHERE i = {mixing.STEPS}) END AS a FROM a0
), q AS (
  SELECT source, t, CASE WHEN t > 0 THEN pow(t, a) / (SELECT sum(pow(t, a)) FROM t WHERE t > 0) ELSE 0 END AS w FROM t, a
), quota AS (SELECT source, t, w, floor(round(w * (SELECT sum(t) FROM t), 3)) AS quota FROM q),
s AS (
  SELECT doc_id, source, n_tokens, block, row_number() OVER (PARTITION BY source, block ORDER BY k) AS place,
    sum(n_tokens) OVER (PARTITION BY source ORDER BY block, k) AS upto FROM e
), c AS (
  SELECT doc_id, s.source, n_tokens, round(w, 7) AS weight, block, place,
    (CASE WHEN t > 0 THEN floor(quota / t) ELSE 1 END + CASE WHEN n_tokens > 0 AND upto <= quota - floor(quota / t) * t THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM s JOIN quota ON s.source IS NOT DISTINCT FROM quota.source
)
SELECT doc_id, source, n_tokens, weight, copies, block, place FROM c WHERE copies > 0
"""

_OP11 = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)
), u AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM p) GROUP BY ALL),
b AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
t AS (
  SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p))
  GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
), longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM t UNION ALL SELECT lang, y, z, f FROM t) GROUP BY ALL),
two AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, ux.f AS l, uy.f AS r, (1000000::HUGEINT * b.f * b.f) // (ux.f::HUGEINT * uy.f) AS score
  FROM b JOIN u ux ON ux.lang = b.lang AND ux.w = b.x JOIN u uy ON uy.lang = b.lang AND uy.w = b.y LEFT JOIN longer g ON g.lang = b.lang AND g.x = b.x AND g.y = b.y
  WHERE g.f IS NULL OR 100 * g.f < {collocations.COVERED} * b.f
), cuts AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, ux.f AS l1, yz.f AS r1, xy.f AS l2, uz.f AS r2,
    (1000000::HUGEINT * t.f * t.f) // (ux.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (xy.f::HUGEINT * uz.f) AS s2
  FROM t JOIN u ux ON ux.lang = t.lang AND ux.w = t.x JOIN u uz ON uz.lang = t.lang AND uz.w = t.z
    JOIN b xy ON xy.lang = t.lang AND xy.x = t.x AND xy.y = t.y JOIN b yz ON yz.lang = t.lang AND yz.x = t.y AND yz.y = t.z
), every AS (
  SELECT * FROM two
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every) JOIN (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY lang) USING (lang)
WHERE rank <= {TOP_PHRASES}
"""

_OP13 = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS c,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS k
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, k), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM base
), broken AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM broken
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS earlier
  FROM placed
), tally AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY c
), follows(state, role) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
adds(state, n, reached) AS (VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'), ('a', 0, 'a'), ('a', 1, 'u')),
edits AS (
  SELECT c, i, state, 'D' AS edit, state AS reached, 3 AS cost FROM faults, (VALUES (''), ('s'), ('u'), ('a')) s(state)
  UNION ALL
  SELECT c, i, state, CASE WHEN initial = f.role THEN 'K' ELSE 'R' END, f.role, CASE WHEN initial = f.role THEN 0 ELSE 2 END + (fault = 'truncated')::INT
  FROM faults, follows f WHERE fault NOT IN ('blank', 'duplicate') AND (initial = f.role OR f.role <> 's')
), walk(c, i, state, cost, audit) AS (
  SELECT c, 0::BIGINT, reached, 2 * adds.n, repeat('I', adds.n) FROM tally, adds WHERE state = ''
  UNION ALL
  SELECT c, i, state, w.cost, w.audit FROM (
    SELECT e.c, e.i, a.reached AS state, min({'cost': w.cost + e.cost + 2 * a.n, 'audit': w.audit || e.edit || repeat('I', a.n)}) AS w
    FROM walk w JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.state = w.state JOIN adds a ON a.state = e.reached GROUP BY ALL
  )
), best AS (
  SELECT c, w.cost, w.audit FROM (SELECT w.c, min({'cost': cost, 'audit': audit}) AS w FROM walk w JOIN tally t ON t.c = w.c AND t.n = w.i WHERE state IN ('', 'a') GROUP BY w.c)
), steps AS (
  SELECT c, p, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY c ORDER BY p) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY c ORDER BY p) AS nth,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY c) AS length
  FROM (SELECT c, unnest(range(1, len(audit) + 1)) AS p, unnest(string_split(audit, '')) AS edit FROM best WHERE audit <> '')
), lines AS (
  SELECT s.c, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN length % 2 = 1 AND nth = 1 THEN 'system' WHEN (nth + length) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS said
  FROM steps s LEFT JOIN faults f ON f.c = s.c AND f.i = s.i WHERE edit <> 'D' GROUP BY s.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM base) LEFT JOIN tally USING (c) LEFT JOIN best USING (c) LEFT JOIN lines USING (c)
"""

#: SQL can't say the others: they rest on trained models or inferred wrappers.
ORACLES: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op4_decontamination": _OP4, "op5_url_filters": _OP5, "op6_mixing": _OP6, "op11_collocations": _OP11, "op13_turn_repair": _OP13}
