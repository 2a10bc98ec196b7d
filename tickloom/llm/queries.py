"""Registered queries of the corpus operators, each with its DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tickloom.llm.collocations import collocations
from tickloom.llm.common import prepare, table
from tickloom.llm.language_model import score
from tickloom.llm.licences import scan_licences
from tickloom.llm.mixing import mix
from tickloom.llm.packing import pack
from tickloom.llm.parsing import document_fingerprints
from tickloom.llm.personal_data import personal_data
from tickloom.llm.resampling import resample
from tickloom.llm.secrets import BASE, joined, scan_secrets
from tickloom.llm.simhash import near_duplicates
from tickloom.llm.top_k import top_k
from tickloom.llm.url_rules import judge_urls
from tickloom.llm.whitening import whiten

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op2_genetic_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query()
def op3_simhash_components(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query()
def op4_phrase_fingerprints(spark, sf_dir):
    return document_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op5_personal_data(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


@query()
def op6_licence_scan(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.c) = len(q.c)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query(_TOP_K)
def op7_dual_tree_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


@query()
def op8_attention_scores(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


_URLS = """
WITH rules(rhost, rpath, action) AS (VALUES {rules}),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
""".format(rules=", ".join(str(r) for r in RULES))


@query(_URLS)
def op9_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op10_pareto_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", F.col("taken"))


@query()
def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


_COLLOCATIONS = """
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed), (VALUES (1), (2), (3), (4)) AS sizes(k)
  WHERE i + k - 1 <= len(w)),
f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
split AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inner_ AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, f AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k)) AS i FROM split), (VALUES (2), (3)) AS parts(m)
    WHERE m < k AND i + m - 1 <= k)
  GROUP BY lang, phrase),
left_ AS (
  SELECT s.* FROM split s LEFT JOIN inner_ i ON s.lang = i.lang AND s.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.f),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM left_)),
scored AS (
  SELECT cuts.*, h.f AS l, t.f AS r, 2000000 * a // (h.f + t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query(_COLLOCATIONS)
def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op13_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
