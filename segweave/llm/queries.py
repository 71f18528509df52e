"""The queries and SQL that __spark_entry__.py registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segweave.session import table

from . import ann, html_extract, licenses, mixing, near_dup, packing, pii, topk, toxicity, url_reputation


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_neighbours(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_html": op4_html,
    "op5_url_filters": op5_url_filters,
    "op6_topk": op6_topk,
    "op7_near_dup": op7_near_dup,
    "op8_ann": op8_ann,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licenses_sql() -> str:
    """The phrases' places by slices of the words, and the containment of each template in each line."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = lambda p: f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {listed(p.split())})"
    found = ", ".join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(licenses.PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))
    base = " || ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE [] END" for k, (_, label) in enumerate(licenses.PHRASES))
    templates = ", ".join(f"({k}, '{label}', {listed(sorted(set(text.split())))}, {listed(must.split()) if must else 'CAST([] AS VARCHAR[])'}, {sorted(licenses.family(licenses.TEMPLATES)[k]) or 'CAST([] AS INTEGER[])'})" for k, (label, text, must) in enumerate(licenses.TEMPLATES))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), d2 AS (SELECT *, {_words_sql("text")} AS w FROM d),
  f AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, {found} FROM d2), g AS (SELECT r, doc_id, n_words, {every} AS places, {base} AS base FROM f),
  t(k, label, words, must, family) AS (VALUES {templates}), l AS (SELECT DISTINCT r, {_words_sql("line")} AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
  h AS MATERIALIZED (SELECT r, lw, k, label, family, len(words) AS n, c FROM (SELECT *, len(list_intersect(lw, words)) / len(words) AS c FROM l, t WHERE len(lw) >= 4) WHERE c >= {licenses.THRESHOLD} - 1e-9 AND list_has_all(lw, must)),
  m AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS score FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.r = a.r AND b.lw = a.lw AND list_contains(a.family, b.k) AND (b.c, b.n) > (a.c, a.n)) GROUP BY r)
  SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score FROM g LEFT JOIN m USING (r)"""


def url_filters_sql() -> str:
    """Rules as a case expression, the same moments in common table expressions, and the posterior's share below one half by its power series."""
    rules = sorted(url_reputation.RULES, key=lambda x: -len(x[1] + x[2]))
    pick = lambda give: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{give(a, h + p)}'" for a, h, p in rules) + " END"
    two = "(" + ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES) + ")"

    def strength(units: str, name: str) -> str:
        return f"""{name}_m AS (SELECT count(*) AS u, sum(n) AS sn, sum(k) AS sk, sum(n * n) AS sn2, sum(k * k / n) AS skn FROM {units} WHERE n > 0),
  {name}_r AS (SELECT *, (skn - sk * sk / sn) / (u - 1) AS b, (sk - skn) / (sn - u) AS w, (sn - sn2 / sn) / (u - 1) AS n0, u > 1 AND sn > u AND sk > 0 AND sk < sn AS ok FROM {name}_m),
  {name} AS (SELECT CASE WHEN ok AND (b - w) / (b + (n0 - 1) * w) > 0 THEN least(greatest(1 / ((b - w) / (b + (n0 - 1) * w)) - 1, 1.0), 200.0) ELSE 200.0 END AS s FROM {name}_r)"""

    return rf"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  o AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
  pb AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p),
  h0 AS (SELECT bare AS host, string_split(regexp_replace(bare, '\.$', ''), '.') AS ls, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(1 - good), 0) AS DOUBLE) AS k FROM pb LEFT JOIN o USING (page_id) GROUP BY bare),
  h AS (SELECT host, n, k, CASE WHEN array_to_string(ls[-2:], '.') IN {two} THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix, CASE WHEN array_to_string(ls[-2:], '.') IN {two} THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain FROM h0),
  d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
  {strength("s", "ss")}, {strength("d", "sd")}, {strength("h", "sh")},
  sm AS (SELECT suffix, (k + (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) * (SELECT s FROM ss)) / (n + (SELECT s FROM ss)) AS mean FROM s),
  dm AS (SELECT domain, suffix, (d.k + sm.mean * (SELECT s FROM sd)) / (d.n + (SELECT s FROM sd)) AS mean FROM d JOIN sm USING (suffix)),
  hm AS (SELECT host, h.k + dm.mean * (SELECT s FROM sh) AS a, h.n - h.k + (1 - dm.mean) * (SELECT s FROM sh) AS b FROM h JOIN dm USING (suffix, domain)),
  r AS (SELECT host AS bare, a / (a + b) AS mean, exp(-(a + b) * ln(2) - ln(a) + lgamma(a + b) - lgamma(a) - lgamma(b)) * list_sum(list_transform(range(0, 3000), lambda i: exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) - i * ln(2)))) AS below FROM hm)
  SELECT page_id, host, path, {pick(lambda a, r: r)} AS rule, coalesce({pick(lambda a, r: a)}, CASE WHEN below < {url_reputation.TAIL} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate FROM pb LEFT JOIN r USING (bare)"""


#: Every row is a candidate of its own, those that repeat an id as well.
TOPK_SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.r <> d.r)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses_sql(), "op5_url_filters": url_filters_sql(), "op6_topk": TOPK_SQL}
