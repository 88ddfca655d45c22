"""The corpus operators as queries over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import decontaminate, gumbel_encode, license_scan, lm_scoring, merkle, near_dedup, quality, substring_dedup, token_rollup, url_rules
from .common import doc_fold, shared_dir, table


def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lm_scoring.score_texts(docs, doc_fold(docs["doc_id"], 10) == 0, docs["lang"])


def op2_token_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return token_rollup.corpus_history(docs, f"{shared_dir(spark)}/rollups/{uuid.uuid4().hex}")


def op3_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op4_gumbel_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gumbel_encode.samples_of(docs)


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_texts(docs, table(spark, sf_dir, "labels"), lambda i: doc_fold(i, 3) != 1)
    return scored.select("doc_id", (doc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_merkle(spark, sf_dir):
    return merkle.edited_pairs(spark, table(spark, sf_dir, "documents"))


def op8_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(spark, pages, url_rules.default_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.remove_repeats(docs))


def op10_license_scan(spark, sf_dir):
    return license_scan.matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries():
    return {f.__name__: f for f in (op1_lm_scoring, op2_token_rollup, op3_decontaminate, op4_gumbel_encode, op5_quality, op6_near_dedup, op7_merkle, op8_url_rules, op9_substring_dedup, op10_license_scan)}


#: Of `text`: its paragraphs as node=blocks with a comma behind, then its sections.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BLOCK_LIST = rf"list_filter(list_transform(string_split(regexp_replace(p, '([gyoGYO.!?:;0-4ао。][\x20\x09-\x0D]+)', '\1' || chr(10), 'g'), chr(10)), lambda b: trim(b, {SPACES})), lambda b: b <> '')"
PARAGRAPHS = f"list_transform(string_split(text, chr(10)), lambda p: sha256(p) || '=' || coalesce(list_aggregate(list_transform({BLOCK_LIST}, lambda b: md5(b)[1:8]), 'string_agg', ''), '') || ',')"
SECTIONS = rf"list_filter(string_split(regexp_replace(list_aggregate({PARAGRAPHS}, 'string_agg', ''), '(0=[0-9a-f]*,)', '\1;', 'g'), ';'), lambda s: s <> '')"
NODE = "sha256(regexp_replace(s, '=[0-9a-f]*', '', 'g'))"
FINGERPRINT = f"""
sha256(list_aggregate(list_transform(found, lambda s: {NODE}), 'string_agg', '')) || ':'
 || list_aggregate(list_transform(found, lambda s: {NODE}[1:16] || '.' || regexp_replace(s, '[0-9a-f]{{64}}=|,', '', 'g')), 'string_agg', ';')
"""
BRANCHES = "string_split({0}[66:], ';')"


def without(a, b):
    return f"list_distinct(list_filter({BRANCHES.format(a)}, lambda s: NOT list_contains({BRANCHES.format(b)}, s)))"


def near(a, b):
    blocks = lambda x, y: f"list_distinct(regexp_extract_all(coalesce(list_aggregate(list_transform({without(x, y)}, lambda s: s[18:]), 'string_agg', ''), ''), '[0-9a-f]{{8}}'))"
    shared = f"CAST(coalesce(list_sum(list_transform(list_distinct(list_intersect({BRANCHES.format(a)}, {BRANCHES.format(b)})), lambda s: (length(s) - 17) // 8)), 0) AS BIGINT)"
    x, y = blocks(a, b), blocks(b, a)
    both = f"(2 * {shared} + len({x}) + len({y}))"
    return f"CAST(CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0 WHEN {both} = 0 THEN 0.0 ELSE least(0.999, 2.0 * ({shared} + len(list_intersect({x}, {y}))) / {both}) END AS DOUBLE)"


OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
follows AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
e AS (SELECT doc_id, length(text) AS n_chars, text, next_text, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM follows),
own AS (SELECT *, {FINGERPRINT} AS fingerprint FROM (SELECT *, {SECTIONS} AS found FROM e)),
changed AS (SELECT *, {FINGERPRINT} AS edited_fingerprint FROM (SELECT * EXCLUDE (text, found), edited AS text, {SECTIONS.replace("text", "edited")} AS found FROM own)),
successor AS (SELECT *, {FINGERPRINT} AS next_fingerprint FROM (SELECT * EXCLUDE (text, found), {SECTIONS.replace("text", "next_text")} AS found FROM changed))
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {near("fingerprint", "edited_fingerprint")} AS near_edited, {near("fingerprint", "next_fingerprint")} AS near_next,
  CAST(len({BRANCHES.format("fingerprint")}) AS BIGINT) AS sections, CAST(len({without("edited_fingerprint", "fingerprint")}) AS BIGINT) AS edited_sections
FROM successor
"""

OP8 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""


OP9 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""


OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = w.doc_id
"""


def oracle_sql():
    return {"op6_near_dedup": OP6, "op7_merkle": OP7, "op8_url_rules": OP8, "op9_substring_dedup": OP9}
