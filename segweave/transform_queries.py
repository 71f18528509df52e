"""Queries that run the shipped encodings, transforms and passes over the test tables, with SQL that states their output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import code_symbols, codecs, profiles, transforms, vectors
from .plans import passes, planner
from .plans.passes import Context
from .plans.segments import KEY, positioned, segment
from .session import table
from .sources import requests
from .workloads import CONV, DOCS, EVENTS, LOW, ORACLE_SQL, TASK, WANTED, WANTED_SQL, _symbols_sql, conv_segments, doc_segments, event_segments, line_tables, mixed_segments, query

LF = "chr(10)"
ALERT_RE = "|".join(X.ALERTS)
MUST_RE = "|".join([*X.ALERTS, *WANTED]).replace(".", r"\.")


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# JSON and logs

_FIELDS = {"l_linenumber": "CAST(l_linenumber AS VARCHAR)", "l_linestatus": "'\"' || l_linestatus || '\"'", "l_orderkey": "CAST(l_orderkey AS VARCHAR)", "l_partkey": "CAST(l_partkey AS VARCHAR)", "l_quantity": "CAST(l_quantity AS VARCHAR)", "l_returnflag": "'\"' || l_returnflag || '\"'"}
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus"
_EACH = range(1, len(_FIELDS) + 1)
#: Of each blob of hundred orders: the JSON text and its columnar form, constant columns once and rows of the others.
CRUSHED = f"""r AS (SELECT l_orderkey // 100 AS blob, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY {_ORDER}) AS i, [{", ".join(_FIELDS.values())}] AS v,
   '{{' || array_to_string(['"l_orderkey":' || l_orderkey, '"l_linenumber":' || l_linenumber, '"l_partkey":' || l_partkey, '"l_quantity":' || l_quantity, '"l_returnflag":"' || l_returnflag || '"', '"l_linestatus":"' || l_linestatus || '"'], ',') || '}}' AS row FROM lineitem),
  c AS (SELECT blob, count(*) AS n, [{", ".join(f"count(DISTINCT v[{k}]) = 1" for k in _EACH)}] AS same, [{", ".join(f"min(v[{k}])" for k in _EACH)}] AS one, '[' || string_agg(row, ',' ORDER BY i) || ']' AS text FROM r GROUP BY blob),
  e AS (SELECT blob, n, any_value(text) AS text, '⟪jc1⟫[' || array_to_string(list_transform(list_filter(range(1, {len(_FIELDS) + 1}), lambda k: NOT any_value(same)[k]), lambda k: '"' || {listed(_FIELDS)}[k] || '"'), ',') || ']' || {LF} || '{{' ||
    array_to_string(list_transform(list_filter(range(1, {len(_FIELDS) + 1}), lambda k: any_value(same)[k]), lambda k: '"' || {listed(_FIELDS)}[k] || '":' || any_value(one)[k]), ',') || '}}' || {LF} || string_agg(line, {LF} ORDER BY i) AS enc
   FROM (SELECT r.blob, n, text, same, one, i, '[' || array_to_string(list_transform(list_filter(range(1, {len(_FIELDS) + 1}), lambda k: NOT same[k]), lambda k: v[k]), ',') || ']' AS line FROM r JOIN c ON r.blob = c.blob) GROUP BY blob, n),
  crushed AS (SELECT blob, text, CASE WHEN n >= 3 AND octet_length(encode(enc)) < octet_length(encode(text)) THEN enc END AS encoded FROM e)"""


@query(f"WITH {CRUSHED} SELECT blob, encoded, CASE WHEN encoded IS NOT NULL THEN true END AS exact FROM crushed")
def json_crush(spark, sf_dir):
    return line_tables(spark, sf_dir).withColumn("encoded", codecs.json_crush("text")).select("blob", "encoded", codecs.round_trips("text", "encoded").alias("exact"))


@query(f"WITH {CRUSHED} SELECT blob, CAST(json_array_length(text) AS BIGINT) AS n, list_sum(list_transform(CAST(json_extract(text, '$[*].l_partkey') AS BIGINT[]), lambda x: x))::BIGINT AS parts FROM crushed WHERE encoded IS NOT NULL")
def json_expand_check(spark, sf_dir):
    """What comes back out of the columnar form, counted and summed."""
    enc = line_tables(spark, sf_dir).select("blob", codecs.expand(codecs.json_crush("text")).alias("back")).where("back is not null")
    rows = F.from_json("back", "array<struct<l_partkey: bigint>>")
    return enc.select("blob", F.size(rows).cast("long").alias("n"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["l_partkey"]).alias("parts"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, text: a log of each user's events."""
    line = F.concat_ws(" ", F.lit("INFO user"), "user_id", F.lit("did"), "event_type", "props")
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


LOGS = f"""ll AS (SELECT user_id, event_id, 'INFO user ' || user_id || ' did ' || event_type || ' ' || props AS line FROM events), lf AS (SELECT *, string_split(line, ' ') AS f FROM ll),
  lw AS (SELECT user_id, count(*) AS n, string_agg(line, {LF} ORDER BY event_id) AS text, [{", ".join(f"count(DISTINCT f[{k}]) = 1" for k in range(1, 8))}] AS same, [{", ".join(f"min(f[{k}])" for k in range(1, 8))}] AS one, bool_and(len(f) = 7) AS even FROM lf GROUP BY user_id),
  le AS (SELECT lw.user_id, any_value(text) AS text, any_value(n) AS n, any_value(even) AS even, '⟪lc1⟫[7,{{' || array_to_string(list_transform(list_filter(range(1, 8), lambda k: any_value(same)[k]), lambda k: '"' || (k - 1) || '":"' || replace(any_value(one)[k], '"', '\\"') || '"'), ',') || '}},[]]' || {LF} ||
    string_agg(array_to_string(list_transform(list_filter(range(1, 8), lambda k: NOT same[k]), lambda k: f[k]), ' '), {LF} ORDER BY event_id) AS enc FROM lf JOIN lw ON lf.user_id = lw.user_id GROUP BY lw.user_id),
  logs AS (SELECT user_id, text, CASE WHEN n >= 4 AND even AND octet_length(encode(enc)) < octet_length(encode(text)) THEN enc END AS encoded FROM le)"""


@query(f"WITH {LOGS} SELECT user_id, encoded, CASE WHEN encoded IS NOT NULL THEN true END AS exact FROM logs")
def log_crush(spark, sf_dir):
    return event_logs(spark, sf_dir).withColumn("encoded", codecs.log_crush("text")).select("user_id", "encoded", codecs.round_trips("text", "encoded").alias("exact"))


@query(f"WITH {LOGS} SELECT user_id, sha256(text) AS content FROM logs WHERE encoded IS NOT NULL")
def log_expand(spark, sf_dir):
    back = event_logs(spark, sf_dir).select("user_id", codecs.expand(codecs.log_crush("text")).alias("back"))
    return back.where("back is not null").select("user_id", F.sha2("back", 256).alias("content"))


def blob_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as JSON and logs of events, as tool outputs of two sessions."""
    tables = line_tables(spark, sf_dir).select(F.lit("tables").alias("session_id"), F.col("blob").alias("position"), "text")
    logs = event_logs(spark, sf_dir).select(F.lit("logs").alias("session_id"), F.col("user_id").alias("position"), "text")
    return segment(tables.unionByName(logs).select("session_id", "position", F.lit("tool").alias("role"), F.lit("tool_output").alias("kind"), F.lit("t").alias("tool_class"), "text"))


_SHORTER = "SELECT {session} AS session_id, CAST({id} AS BIGINT) AS seg_id, CAST((length(encoded) + 3) // 4 AS INTEGER) AS new_tokens, encoded AS rendered FROM {of} WHERE (length(encoded) + 3) // 4 < (length(text) + 3) // 4"


@query(f"WITH {CRUSHED} {_SHORTER.format(session=chr(39) + 'tables' + chr(39), id='blob', of='crushed')}")
def json_compaction(spark, sf_dir):
    return passes.json_compaction(blob_segments(spark, sf_dir), Context()).select(*KEY, "new_tokens", "rendered")


@query(f"WITH {LOGS} {_SHORTER.format(session=chr(39) + 'logs' + chr(39), id='user_id', of='logs')}")
def log_compaction(spark, sf_dir):
    return passes.log_compaction(blob_segments(spark, sf_dir), Context()).select(*KEY, "new_tokens", "rendered")


# lossy transforms

ROW_TASK = "list the urgent ones"
_SHORT = "CASE WHEN octet_length(encode(c)) < octet_length(encode(text)) THEN c END"


@query(
    f"""WITH r AS (SELECT o_orderkey // 200 AS blob, '{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}' AS row, row_number() OVER (PARTITION BY o_orderkey // 200 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderkey // 200) AS n FROM orders),
  k AS (SELECT *, i <= 3 OR i > n - 3 OR regexp_matches({LOW.format("row")}, '{ALERT_RE}|list|urgent|ones') AS keep FROM r),
  t AS (SELECT blob, n, count(*) FILTER (WHERE keep) AS kept, '[' || string_agg(row, ',' ORDER BY i) || ']' AS text, string_agg(row, {LF} ORDER BY i) FILTER (WHERE keep) AS body FROM k GROUP BY blob, n),
  o AS (SELECT *, body || {LF} || '[lossy: ' || (n - kept) || ' of ' || n || ' uniform rows elided; kept boundary+anomalies]' AS c FROM t)
  SELECT blob, CASE WHEN n > 8 AND kept < n THEN {_SHORT} END AS compact FROM o"""
)
def lossy_json_rows(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus")))
    t = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 200").alias("blob")).agg(F.to_json(rows).alias("text"))
    return t.select("blob", transforms.lossy_udf(3, ROW_TASK)("text").alias("compact"))


def line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.regexp_count("text", F.lit("\n")) >= transforms.LEAST_NEWLINES)


_L = f"""l AS (SELECT doc_id, text, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, text, string_split(text, {LF}) AS ls FROM documents) WHERE len(ls) >= 5)"""
_NOTE = f"""body || {LF} || '[lossy: ' || (n - kept) || ' of ' || n || ' lines elided; kept boundary+alerts+relevant{{more}}]'"""


@query(
    f"""WITH {_L}, k AS (SELECT *, i <= 3 OR i > n - 3 OR regexp_matches({LOW.format("line")}, '{MUST_RE}') AS keep FROM l),
  t AS (SELECT doc_id, n, any_value(text) AS text, count(*) FILTER (WHERE keep) AS kept, string_agg(CASE WHEN length(line) > 40 THEN left(line, 40) || '…' ELSE line END, {LF} ORDER BY i) FILTER (WHERE keep) AS body FROM k GROUP BY doc_id, n),
  o AS (SELECT *, {_NOTE.format(more="; lines truncated")} AS c FROM t) SELECT doc_id, CASE WHEN n > 10 THEN {_SHORT} END AS compact FROM o"""
)
def lossy_lines(spark, sf_dir):
    return line_docs(spark, sf_dir).select("doc_id", transforms.lossy_udf(3, TASK, 40)("text").alias("compact"))


_SCORE = "coalesce(list_sum(list_transform(regexp_extract_all(line, '[\\p{L}\\p{N}]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN 3 WHEN regexp_matches(w, '^\\p{Lu}') AND octet_length(encode(w)) > 2 THEN 2 WHEN octet_length(encode(w)) >= 8 THEN 1 ELSE 0 END)), 0)"


@query(
    f"""WITH {_L}, s AS (SELECT *, {_SCORE} AS score, i <= 3 OR i > n - 3 OR regexp_matches({LOW.format("line")}, '{ALERT_RE}') AS must FROM l WHERE n > 10),
  f AS (SELECT doc_id, list_sort(list(score) FILTER (WHERE score > 0)) AS facts, count(*) FILTER (WHERE must) AS musts FROM s GROUP BY doc_id),
  k AS (SELECT s.*, musts, must OR (facts IS NOT NULL AND score >= facts[2 * len(facts) // 3 + 1]) AS want FROM s JOIN f USING (doc_id)),
  c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, want AND NOT must ORDER BY score DESC, i) AS r, count(*) FILTER (WHERE want) OVER (PARTITION BY doc_id) AS wanted FROM k),
  d AS (SELECT *, must OR want AND (wanted <= 12 OR r <= greatest(12 - musts, 0)) AS keep FROM c),
  t AS (SELECT doc_id, n, any_value(text) AS text, count(*) FILTER (WHERE keep) AS kept, string_agg(line, {LF} ORDER BY i) FILTER (WHERE keep) AS body FROM d GROUP BY doc_id, n),
  o AS (SELECT *, {_NOTE.format(more="")} AS c FROM t) SELECT doc_id, CASE WHEN kept < n THEN {_SHORT} END AS compact FROM o"""
)
def cap_rows_topk(spark, sf_dir):
    """Lines by salience, at most twelve beside those that must stay."""
    d = line_docs(spark, sf_dir).where(F.size(X.lines_of(F.col("text"))) > 10)
    return d.select("doc_id", transforms.lossy_udf(3, None, 0, 12)("text").alias("compact"))


@query(
    f"""WITH r AS (SELECT o_orderkey // 500 AS blob, o_orderkey || ',' || o_orderpriority || CASE WHEN o_orderkey % 37 = 0 THEN ',critical' WHEN o_orderkey % 41 = 0 THEN ',extra,cells' ELSE ',' || o_orderstatus END AS row, o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 AS odd,
    row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderkey // 500) AS n FROM orders),
  k AS (SELECT *, i <= 3 OR i > n - 3 OR odd AS keep FROM r), g AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY blob ORDER BY i) AS island FROM k),
  p AS (SELECT blob, n, island, min(i) AS i, any_value(CASE WHEN keep THEN row END) AS row, count(*) FILTER (WHERE NOT keep) AS gone FROM g GROUP BY blob, n, island),
  t AS (SELECT blob, n, sum(gone) AS gone, 'order,priority,status' || {LF} || string_agg(row || CASE WHEN gone > 0 THEN {LF} || '… ' || gone || ' rows omitted …' ELSE '' END, {LF} ORDER BY i) AS c FROM p GROUP BY blob, n),
  x AS (SELECT blob, 'order,priority,status' || {LF} || string_agg(row, {LF} ORDER BY i) AS text FROM r GROUP BY blob)
  SELECT blob, CASE WHEN n > 8 AND gone > 0 THEN {_SHORT} END AS compact FROM t JOIN x USING (blob)"""
)
def csv_compact(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 37 == 0, "critical").when(F.col("o_orderkey") % 41 == 0, "extra,cells").otherwise(F.col("o_orderstatus"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(",", "o_orderkey", "o_orderpriority", status).alias("row")))), lambda r: r["row"]), "\n")
    t = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 500").alias("blob")).agg(F.concat(F.lit("order,priority,status\n"), lines).alias("text"))
    return t.select("blob", transforms.csv_udf()("text").alias("compact"))


_STRIPPED = "html"
for _pattern in (r"(?is)<script[^>]*>.*?</script\s*>", r"(?is)<style[^>]*>.*?</style\s*>", r"(?is)<svg[^>]*>.*?</svg\s*>", r"(?s)<!--.*?-->"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', '', 'g')"
_ATTRIBUTE = r"""(?i)\s+(?:style|class|data-[^\s=>/]*|on[a-z][^\s=>/]*)(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>''"=`]+))?"""


@query(
    f"""WITH s AS (SELECT page_id, html AS text, {_STRIPPED} AS x FROM pages), t AS (SELECT page_id, text, array_to_string(list_transform(regexp_extract_all(x, '(?s)<[^>]+>|[^<]+|<'), lambda p: CASE WHEN regexp_matches(p, '(?s)^<[^>]+>$') THEN regexp_replace(p, '{_ATTRIBUTE}', '', 'g') ELSE p END), '') AS y FROM s),
  o AS (SELECT page_id, text, array_to_string(list_filter(list_transform(string_split(y, {LF}), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), {LF}) AS c FROM t) SELECT page_id, {_SHORT} AS compact FROM o"""
)
def html_compact(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", transforms.html_text("html").alias("compact"))


#: What the telegraphic transform leaves of a text's words.
_BARE = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def _telegraphic_sql(rows: str) -> str:
    """doc_id, compact of rows(doc_id, text): words and what is kept of them as rows."""
    return f"""tw AS (SELECT doc_id, text, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, len(ws) AS n FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM {rows}) WHERE len(ws) >= 20),
  tb AS (SELECT *, {_BARE.format("w")} AS bare, regexp_matches(w, '[0-9]') AS num, regexp_matches(w, '^\\p{{Lu}}') AS up FROM tw), ts AS (SELECT *, bare IN ({", ".join(f"'{w}'" for w in sorted(transforms.STOP_WORDS))}) AS stop FROM tb),
  tf AS (SELECT *, num OR up AND NOT stop AS fact FROM ts), tl AS (SELECT *, coalesce(lag(fact) OVER (PARTITION BY doc_id ORDER BY i), false) AS after_fact FROM tf),
  tk AS (SELECT *, bare = '' OR num OR after_fact OR NOT stop AND (up OR octet_length(encode(bare)) >= 5) AS keep FROM tl),
  tg AS (SELECT doc_id, n, any_value(text) AS text, count(*) FILTER (WHERE keep) AS kept, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE keep), '') AS c FROM tk GROUP BY doc_id, n),
  tele AS (SELECT d.doc_id, d.text, CASE WHEN kept < n AND octet_length(encode(c)) < octet_length(encode(d.text)) THEN c END AS compact FROM {rows} d LEFT JOIN tg ON d.doc_id = tg.doc_id)"""


TELEGRAPHIC = _telegraphic_sql("documents")


@query(f"WITH {TELEGRAPHIC} SELECT doc_id, compact FROM tele")
def telegraphic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", transforms.telegraphic_text("text").alias("compact"))


@query(f"WITH {TELEGRAPHIC} SELECT lang || '/' || d.doc_id || '.md' AS path, 'prose' AS class, CAST((length(d.text) + 3) // 4 AS INTEGER) AS original, CAST(NULL AS INTEGER) AS lossless, CAST((length(coalesce(compact, d.text)) + 3) // 4 AS INTEGER) AS lossy FROM documents d JOIN tele USING (doc_id)")
def measure_files(spark, sf_dir):
    return profiles.measure(_prose_files(spark, sf_dir))


def _prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text")


@query(
    f"""WITH {TELEGRAPHIC}, {CRUSHED}, f AS (SELECT (length(d.text) + 3) // 4 AS original, (length(coalesce(compact, d.text)) + 3) // 4 AS saved, 0 AS json FROM documents d JOIN tele USING (doc_id)
   UNION ALL SELECT (length(text) + 3) // 4, (length(coalesce(encoded, text)) + 3) // 4, 1 FROM crushed)
  SELECT 4 AS recency_keep, round(sum(original) / sum(saved), 6) AS ratio, false AS lossy_code, 50 AS max_rows, 120 AS max_field, count(*) AS files FROM f"""
)
def learn_profile(spark, sf_dir):
    tables = line_tables(spark, sf_dir).select(F.concat(F.lit("t/"), "blob", F.lit(".json")).alias("path"), "text")
    return profiles.learn(profiles.measure(_prose_files(spark, sf_dir).unionByName(tables)))


@query(
    f"""WITH {TELEGRAPHIC}, {CRUSHED}, f AS (SELECT (length(d.text) + 3) // 4 AS original, (length(coalesce(compact, d.text)) + 3) // 4 AS lossy, NULL AS lossless FROM documents d JOIN tele USING (doc_id))
  SELECT CAST(sum(original) AS BIGINT) AS original, CAST(sum(lossless) AS BIGINT) AS lossless, CAST(sum(original) FILTER (WHERE lossless IS NOT NULL) AS BIGINT) AS lossless_of, CAST(sum(lossy) AS BIGINT) AS lossy, CAST(NULL AS DOUBLE) AS ratio, CAST(NULL AS DOUBLE) AS ratio_strict FROM f"""
)
def perf_totals(spark, sf_dir):
    return profiles.totals(profiles.measure(_prose_files(spark, sf_dir)))


@query(
    """SELECT p_partkey, '{"description":"' || p_type || '","properties":{"title":{"type":"string"}},"type":"object"}' AS slim FROM part"""
)
def slim_schema(spark, sf_dir):
    schema = F.concat(F.lit('{"$schema":"x","title":"'), "p_name", F.lit('","description":"'), "p_type", F.lit('","type":"object","properties":{"title":{"type":"string","examples":["a"]}}}'))
    return table(spark, sf_dir, "part").select("p_partkey", transforms.schema_text(schema).alias("slim"))


@query(
    f"""SELECT p_partkey, 'def f_' || p_partkey || '(x):' || {LF} || '    # 4 lines hidden' || {LF} AS py, 'struct P(u32);' || {LF} || 'fn f_' || p_partkey || '(x: u32) -> u32 {{ /* 3 lines hidden */ }}' || {LF} AS rs FROM part"""
)
def skeletonize(spark, sf_dir):
    py = F.concat(F.lit("def f_"), "p_partkey", F.lit("(x):\n    a = x\n    b = a + 1\n    c = '"), "p_name", F.lit("'\n    return c\n"))
    rs = F.concat(F.lit("struct P(u32);\nfn f_"), "p_partkey", F.lit("(x: u32) -> u32 {\n    let a = x; // {\n    let s = \"}"), "p_name", F.lit('";\n    a\n}\n'))
    return table(spark, sf_dir, "part").select("p_partkey", transforms.skeleton_text(py, F.lit("f.py")).alias("py"), transforms.skeleton_text(rs, F.lit("f.rs")).alias("rs"))


@query("SELECT p_partkey, list_sort(['load_' || p_partkey, 'text', 'u32', 'value']) AS symbols FROM part")
def ast_symbols(spark, sf_dir):
    code = F.concat(F.lit("fn load_"), "p_partkey", F.lit('(value: u32) -> u32 { // comment word\n  let text = "'), "p_name", F.lit('";\n  value }'))
    return table(spark, sf_dir, "part").select("p_partkey", code_symbols.code_symbols(code, F.lit("a.rs")).alias("symbols"))


@query("SELECT item_id, text || ' [image id= fmt=png ~' || ((4 * ((octet_length(encode(text)) + 2) // 3)) * 3 // 4 // 1024) || 'KB]' AS compact FROM benchmark")
def deref_images(spark, sf_dir):
    """The hash in a marker isn't one that SQL knows, and is left out here; tests put the originals back."""
    text = F.concat("text", F.lit(" data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(transforms.images_text(text), "id=[0-9a-f]{8}", "id=").alias("compact"))


@query(f"WITH {TELEGRAPHIC}, x AS (SELECT doc_id, coalesce(compact, text) AS t FROM tele) SELECT doc_id, CAST(length(t) AS BIGINT) AS chars FROM x")
def sql_functions(spark, sf_dir):
    """The transforms called from SQL; what isn't shortened comes back as it was."""
    profiles.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("segweave_documents")
    return spark.sql("SELECT doc_id, CAST(char_length(telegraphic(text)) AS BIGINT) AS chars FROM segweave_documents")


# passes and whole plans


@query(f"WITH {DOCS}, b AS (SELECT *, first_value(seg_id) OVER w AS base_id, first_value(text) OVER w AS base_text FROM docs WINDOW w AS (PARTITION BY session_id, path ORDER BY seg_id)) SELECT session_id, seg_id, base_id, true AS exact FROM b WHERE seg_id <> base_id AND text <> base_text")
def delta_patch(spark, sf_dir):
    s = doc_segments(spark, sf_dir)
    p = passes.file_delta(s, Context()).select(*KEY, "base_id", "rendered")
    bases = s.select("session_id", F.col("seg_id").alias("base_id"), F.col("text").alias("base_text"))
    both = p.join(s.select(*KEY, "text"), KEY).join(bases, ["session_id", "base_id"])
    return both.select(*KEY, "base_id", codecs.apply_delta("base_text", "rendered").eqNullSafe(F.col("text")).alias("exact"))


def watched_segments(spark: SparkSession, sf_dir: str, lines: int = 30) -> DataFrame:
    """A session for each order status: two outputs for each stretch of orders, its list and its list with one line more."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("session_id"), "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").alias("line"))
    totals = o.groupBy("session_id").agg(F.count("*").alias("n"))
    last = F.greatest(F.expr(f"n div {lines}") - 1, F.lit(0))
    at = positioned(o, "o_orderkey").join(totals, "session_id").withColumn("block", F.least(F.expr(f"position div {lines}"), last))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda r: r["line"]), "\n")
    blocks = at.groupBy("session_id", "block").agg(text.alias("text"))
    more = F.concat("text", F.lit("\nend of stretch "), "block")
    twice = F.array(F.struct((F.col("block") * 2).alias("position"), F.col("text")), F.struct((F.col("block") * 2 + 1).alias("position"), more.alias("text")))
    t = blocks.select("session_id", F.inline(twice))
    return segment(t.select("session_id", "position", F.lit("tool").alias("role"), F.lit("tool_output").alias("kind"), F.lit("watch").alias("tool_class"), "text"))


@query(
    """WITH o AS (SELECT o_orderstatus AS session_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders), b AS (SELECT DISTINCT session_id, least(p // 30, greatest(n // 30 - 1, 0)) AS block FROM o)
  SELECT session_id, block * 2 + 1 AS seg_id, block * 2 AS base_id, true AS exact FROM b"""
)
def envelope_dedup(spark, sf_dir):
    """Each second output is a small delta of the one before it."""
    s = watched_segments(spark, sf_dir)
    p = passes.envelope_dedup(s, Context()).select(*KEY, "base_id", "rendered")
    bases = s.select("session_id", F.col("seg_id").alias("base_id"), F.col("text").alias("base_text"))
    both = p.join(s.select(*KEY, "text"), KEY).join(bases, ["session_id", "base_id"])
    return both.select(*KEY, "base_id", codecs.apply_delta("base_text", "rendered").eqNullSafe(F.col("text")).alias("exact"))


def _closure_sql(rows: str, name: str, wanted: str = WANTED_SQL) -> str:
    """name(session_id, seg_id): what the wanted symbols reach, of rows(session_id, seg_id, text)."""
    return f"""{name}_s AS MATERIALIZED (SELECT DISTINCT session_id, seg_id, unnest({_symbols_sql("text")}) AS symbol FROM {rows}),
  {name}_p AS MATERIALIZED (SELECT DISTINCT a.session_id, a.seg_id, b.seg_id AS other FROM {name}_s a JOIN {name}_s b USING (session_id, symbol) WHERE a.seg_id <> b.seg_id),
  {name}(session_id, seg_id) AS (SELECT DISTINCT session_id, seg_id FROM {name}_s WHERE symbol IN ({wanted}) UNION SELECT p.session_id, p.other FROM {name}_p p JOIN {name} m ON p.session_id = m.session_id AND p.seg_id = m.seg_id)"""


@query(f"WITH RECURSIVE {CONV}, {_closure_sql('conv', 'met')} SELECT session_id, seg_id FROM met")
def relevance_closure(spark, sf_dir):
    return passes.relevance_closure(conv_segments(spark, sf_dir), TASK)


EVENT_TASK = "why did the purchase fail"
_EVENT_WANTED = ", ".join(f"'{w}'" for w in sorted(transforms.symbols_of(EVENT_TASK)))
#: Segments of conversations (what the assistant says is reasoning) and of events, as mixed_segments() has them, and what each pass says.
_MIXED = f"""{CONV}, {EVENTS}, mixed AS (SELECT 'c' || session_id AS session_id, seg_id, text, token_count, CASE role WHEN 'system' THEN 'system_prompt' WHEN 'assistant' THEN 'reasoning_trace' ELSE 'conversation_turn' END AS kind, CAST(NULL AS VARCHAR) AS tool_class FROM conv
    UNION ALL SELECT 'u' || session_id, seg_id, text, token_count, 'tool_output', tool_class FROM ev),
  judged AS (SELECT *, kind = 'tool_output' AND seg_id < max(seg_id) OVER (PARTITION BY session_id, tool_class) AS superseded, kind = 'tool_output' AND row_number() OVER (PARTITION BY session_id, kind = 'tool_output', text ORDER BY seg_id) > 1 AS copied, max(seg_id) OVER (PARTITION BY session_id) AS last FROM mixed)"""
_REPORT = "SELECT session_id, CAST(sum(token_count) AS BIGINT) AS input_tokens, CAST(coalesce(sum(token_count) FILTER (WHERE NOT gone), 0) AS BIGINT) AS net_tokens, count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS dropped, CAST(0 AS BIGINT) AS replaced, round(coalesce(sum(token_count) FILTER (WHERE NOT gone), 0) / sum(token_count), 6) AS ratio FROM {0} GROUP BY session_id"


@query(f"WITH {_MIXED}, g AS (SELECT *, superseded OR copied AS gone FROM judged) {_REPORT.format('g')}")
def compress_structural(spark, sf_dir):
    return planner.report(planner.make_plan(mixed_segments(spark, sf_dir), passes=passes.STRUCTURAL))


_QUERIED = f"""{_MIXED}, {_closure_sql("mixed", "met", _EVENT_WANTED)},
  g AS (SELECT j.*, superseded OR copied OR (kind = 'tool_output' AND last - j.seg_id >= 6 AND m.seg_id IS NULL) OR (kind = 'reasoning_trace' AND last - j.seg_id >= 3 AND NOT regexp_matches({LOW.format("text")}, '{"|".join(X.CONCLUSIONS)}')) AS gone
   FROM judged j LEFT JOIN met m ON j.session_id = m.session_id AND j.seg_id = m.seg_id)"""


@query(f"WITH RECURSIVE {_QUERIED} {_REPORT.format('g')}")
def compress_query(spark, sf_dir):
    return planner.report(planner.make_plan(mixed_segments(spark, sf_dir), EVENT_TASK))


_BUDGET = 60


@query(
    f"""WITH RECURSIVE {_QUERIED}, freq AS (SELECT session_id, seg_id, count(*) AS frequency FROM met_p GROUP BY ALL), need AS (SELECT DISTINCT session_id, seg_id FROM met_s WHERE symbol IN ({_EVENT_WANTED})),
  prio AS (SELECT g.*, (CASE WHEN n.seg_id IS NULL THEN 0 ELSE 1 END) * 1000000000 + coalesce(frequency, 0) * 100000 + g.seg_id AS priority FROM g LEFT JOIN freq f ON g.session_id = f.session_id AND g.seg_id = f.seg_id LEFT JOIN need n ON g.session_id = n.session_id AND g.seg_id = n.seg_id),
  tot AS (SELECT session_id, sum(token_count) FILTER (WHERE NOT gone) AS net FROM g GROUP BY session_id),
  run AS (SELECT session_id, seg_id, coalesce(sum(token_count) OVER (PARTITION BY session_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM prio WHERE kind <> 'system_prompt' AND NOT gone),
  b AS (SELECT p.session_id, p.token_count, p.gone OR coalesce(net > {_BUDGET} AND net - before > {_BUDGET}, false) AS gone FROM prio p JOIN tot USING (session_id) LEFT JOIN run r ON p.session_id = r.session_id AND p.seg_id = r.seg_id) {_REPORT.format("b")}"""
)
def compress_budgeted(spark, sf_dir):
    return planner.report(planner.make_plan(mixed_segments(spark, sf_dir), EVENT_TASK, budget=_BUDGET))


@query(
    f"""WITH {EVENTS}, d AS (SELECT *, seg_id < max(seg_id) OVER (PARTITION BY session_id, tool_class) AS superseded, row_number() OVER (PARTITION BY session_id, text ORDER BY seg_id) > 1 AS copied, max(seg_id) OVER (PARTITION BY session_id, tool_class) AS latest FROM ev WHERE seg_id >= 5),
  g AS (SELECT *, superseded OR copied AS gone FROM d) {_REPORT.format("g")}"""
)
def session_plan(spark, sf_dir):
    """The second of two turns, planned against what the first one ran."""
    from .plans import engine

    s = event_segments(spark, sf_dir)
    _, state = engine.plan_turn(engine.SessionState.empty(spark), s.where("position < 5"), passes=[passes.supersession])
    plan, _ = engine.plan_turn(state, s.where("position >= 5"), passes=[passes.supersession, passes.exact_dedup])
    return planner.report(plan)


# scalar functions beyond those of workloads


@query("SELECT page_id, CASE list_extract(['rs', 'py', 'tsx', 'cc', 'pm', 'txt'], CAST(page_id % 6 + 1 AS INTEGER)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'tsx' WHEN 'cc' THEN 'cpp' WHEN 'pm' THEN 'perl' END AS language, CASE list_extract(['rs', 'py', 'tsx', 'cc', 'pm', 'txt'], CAST(page_id % 6 + 1 AS INTEGER)) WHEN 'rs' THEN 'code' WHEN 'py' THEN 'code' WHEN 'tsx' THEN 'code' ELSE 'prose' END AS class FROM pages")
def languages(spark, sf_dir):
    path = F.concat(F.lit("src/a."), F.element_at(F.array(*[F.lit(e) for e in ("rs", "py", "tsx", "cc", "pm", "txt")]), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", X.language(path).alias("language"), X.file_class(path).alias("class"))


@query(f"SELECT doc_id, regexp_matches({LOW.format('text')}, '{'|'.join(WANTED).replace('.', chr(92) + '.')}') AS relevant, left(sha256(text), 16) AS content_id FROM documents")
def relevance_and_ids(spark, sf_dir):
    wanted = F.array(*[F.lit(w) for w in WANTED])
    return table(spark, sf_dir, "documents").select("doc_id", X.is_relevant(F.col("text"), wanted).alias("relevant"), X.content_id(F.col("text")).alias("content_id"))


_SPANS = {"path": r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+|/[A-Za-z0-9_./-]+", "line_number": r":[0-9]+(?::[0-9]+)?\b", "error_code": r"\b[EC][0-9]{3,5}\b", "numeric_literal": r"\b[0-9]+\b", "null_vs_empty": r"\bnull\b|\"\"|''''"}
_SPAN_TEXT = "url || ':' || page_id || ' E' || (page_id % 2000) || ' null'"
_SPAN_ROWS = " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, regexp_extract_all(u, '{p}') AS hits, string_split_regex(u, '{p}') AS gaps FROM t" for kind, p in _SPANS.items())


@query(
    f"""WITH t AS (SELECT page_id, {_SPAN_TEXT} AS u FROM pages), h AS ({_SPAN_ROWS}), s AS (SELECT page_id, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM h)
  SELECT page_id, kind, CAST(start AS BIGINT) AS start, CAST(start + length(hits[k]) AS BIGINT) AS "end" FROM (SELECT *, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start FROM s)"""
)
def protected_spans(spark, sf_dir):
    text = F.concat("url", F.lit(":"), "page_id", F.lit(" E"), F.col("page_id") % 2000, F.lit(" null"))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(X.protected_spans(text)))


@query("""SELECT event_id, regexp_replace(regexp_replace(left(x, 60), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Z|a-z]{2,}', '<email>', 'g'), 'Bearer [A-Za-z0-9\\-._~+/]+=*', '<tok>', 'g') AS safe, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN (event_id // 60) || 'm ' || (event_id % 60) || 's' ELSE (event_id // 3600) || 'h ' || (event_id % 3600 // 60) || 'm' END AS uptime FROM (SELECT event_id, 'mail u' || user_id || '@example.org Bearer ' || event_type || '.x=' AS x FROM events)""")
def redacted(spark, sf_dir):
    text = F.concat(F.lit("mail u"), "user_id", F.lit("@example.org Bearer "), "event_type", F.lit(".x="))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace(X.redact(text, 60), "Bearer <tok>", "<tok>").alias("safe"), X.uptime(F.col("event_id")).alias("uptime"))


@query("SELECT event_id, CASE WHEN ms < 1 THEN format('{:.0f}', ms * 1000) || 'µs' WHEN ms < 1000 THEN format('{:.1f}ms', ms) ELSE format('{:.2f}s', ms / 1000) END AS t FROM (SELECT event_id, (event_id * 64 + 9) / 128.0::DOUBLE AS ms FROM events)")
def short_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.short_time((F.col("event_id") * 64 + 9) / F.lit(128.0)).alias("t"))


@query("SELECT a.p_partkey AS a, (a.p_size, a.p_partkey % 10, 0) > (a.p_partkey % 50, a.p_size % 10, 3) AS newer FROM part a")
def newer_versions(spark, sf_dir):
    a = X.version_parts(F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 10, F.lit(".0-rc1")))
    b = X.version_parts(F.concat(F.col("p_partkey") % 50, F.lit("."), F.col("p_size") % 10, F.lit(".3")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (a > b).alias("newer"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+', '')), lambda s: s <> '')) AS BIGINT) AS n FROM documents"""
)
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences_of(F.col("text"))).cast("long").alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / s)), 5) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS s FROM embeddings)")
def normalised(spark, sf_dir):
    v = X.normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS BIGINT) AS n, regexp_extract(text, '[A-Za-z]+') AS first FROM documents")
def distinct_in_order(spark, sf_dir):
    words = X.distinct_in_order(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id // 7 END AS read, CASE WHEN event_id % 3 = 0 THEN 5 END AS created, CAST(event_id AS BIGINT) AS output_tokens, event_id % 4 = 0 AS hour FROM events"""
)
def response_usage(spark, sf_dir):
    """Figures at the head and at the tail of long responses, of which only short windows are looked through."""
    k = F.col("event_id")
    cached = F.when(k % 3 == 0, F.concat(F.lit('{"cache_read_input_tokens": '), F.expr("event_id div 7"), F.lit(', "cache_creation_input_tokens":5,'))).otherwise(F.lit('{"cache_read_input_tokens": 9,'))
    body = F.concat(cached, F.lit('"output_tokens":1,'), F.repeat(F.lit("x"), 300), F.lit('"output_tokens": '), k, F.lit("}"))
    request = F.concat(F.lit('{"system":[{"cache_control":{"ttl": "'), F.when(k % 4 == 0, "1h").otherwise("5m"), F.lit('"}}]}'))
    u = X.cache_usage(body, 120, 60)
    rows = table(spark, sf_dir, "events").select("event_id", u.alias("u"), X.tail_first_output(body, 120, 60).alias("output_tokens"), X.hour_long_cache(request).alias("hour"))
    return rows.select("event_id", "u.read", "u.created", "output_tokens", "hour")


# sources, extension points and soundness


@query(f"WITH {CONV} SELECT session_id, CAST(seg_id AS INTEGER) AS position, role, kind, CAST(NULL AS VARCHAR) AS tool_class, text FROM conv")
def context_blocks(spark, sf_dir):
    """Conversations as JSON arrays of blocks, and back."""
    s = conv_segments(spark, sf_dir)
    block = F.struct("role", "kind", F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("path"), "text")
    rows = F.array_sort(F.collect_list(F.struct("position", block.alias("b"))))
    given = s.groupBy("session_id").agg(F.to_json(F.transform(rows, lambda r: r["b"])).alias("value"))
    return requests.context_blocks(given).select("session_id", "position", "role", "kind", "tool_class", "text")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS position, CASE WHEN turn % 5 = 4 THEN 'user' WHEN turn % 5 = 3 THEN 'tool' ELSE role END AS role,
  CASE WHEN turn % 5 = 4 THEN 'conversation_turn' WHEN turn % 5 = 3 THEN 'tool_output' WHEN role = 'system' THEN 'system_prompt' ELSE 'conversation_turn' END AS kind,
  CASE WHEN turn % 5 = 3 THEN CASE WHEN conv_id % 3 = 0 THEN 'grep' WHEN conv_id % 3 = 1 THEN 'call_' || conv_id ELSE 'tool' END END AS tool_class FROM conversations"""
)
def message_blocks(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id")
    m = table(spark, sf_dir, "conversations").select(
        c.cast("string").alias("session_id"), t.alias("position"), F.when(t % 5 == 4, "narrator").when(t % 5 == 3, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(c % 3 == 0, "grep").alias("name"), F.when(c % 3 == 1, F.concat(F.lit("call_"), c)).alias("tool_call_id"),
    )
    return requests.message_blocks(m).select("session_id", "position", "role", "kind", "tool_class")


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || {LF} || '{{\"type\":\"image\",\"url\":\"u\"}}' END AS text FROM conversations")
def content_coercion(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    parts = F.concat(F.lit('[{"type":"text","text":'), quoted, F.lit('},{"type":"image","url":"u"}]'))
    return c.select("conv_id", "turn", requests.content_text(F.when(F.col("turn") % 2 == 0, quoted).otherwise(parts)).alias("text"))


@query(f"WITH {CONV} SELECT session_id, CAST(sum((octet_length(encode(text)) + 3) // 4) AS BIGINT) AS tokens FROM conv GROUP BY session_id")
def byte_counter(spark, sf_dir):
    """Segments counted by another counter, of a quarter of the bytes."""
    blocks = conv_segments(spark, sf_dir).select("session_id", "position", "role", "kind", "text")
    s = segment(blocks, lambda text: F.floor((F.octet_length(text) + 3) / 4).cast("int"))
    return s.groupBy("session_id").agg(F.sum("token_count").alias("tokens"))


@query(f"WITH {DOCS}, b AS (SELECT *, min(seg_id) OVER (PARTITION BY session_id, path) AS base_id FROM docs) SELECT session_id, seg_id, CASE WHEN seg_id = base_id THEN 'drop' ELSE 'keep' END AS action FROM b")
def deltas_without_base(spark, sf_dir):
    """Every first read is dropped by a later pass, so all deltas against them are turned back."""
    s = doc_segments(spark, sf_dir)
    bases = passes.file_bases(s).select("session_id", F.col("base_id").alias("seg_id"))
    gone = passes._proposal(bases, "drop", "superseded")
    return planner.enforce(s, planner.resolve(s, [passes.file_delta(s, Context()), gone])).select(*KEY, "action")


@query(f"WITH {CONV} SELECT session_id, seg_id, CASE WHEN kind = 'system_prompt' THEN 'keep' WHEN seg_id % 2 = 0 THEN 'drop' ELSE 'keep' END AS action FROM conv")
def unsound_proposals(spark, sf_dir):
    """Drops of frozen segments and replacements that nothing undoes are turned back."""
    s = conv_segments(spark, sf_dir)
    drops = passes._proposal(s.where("kind = 'system_prompt' or seg_id % 2 = 0"), "drop", "evicted")
    wrong = passes._proposal(s.where("kind <> 'system_prompt' and seg_id % 2 = 1"), "replace", "duplicate", F.lit("⟪jc1⟫x"), "json_columnar")
    return planner.enforce(s, planner.resolve(s, [drops, wrong])).select(*KEY, "action")


@query(f"WITH {CONV} SELECT session_id, seg_id FROM conv WHERE length(text) % 3 = 0")
def own_pass(spark, sf_dir):
    """A pass of one's own beside the engine's."""
    mine = lambda segments, ctx: passes._proposal(segments.where(F.char_length("text") % 3 == 0), "drop", "mine")
    s = conv_segments(spark, sf_dir).withColumn("mutation_class", F.lit("fast"))
    return planner.dropped(planner.make_plan(s, passes=[mine])).select(*KEY)


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), e) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(e, e))) AS s FROM embeddings, q)
  SELECT vec_id, round(s, 6) AS score FROM c ORDER BY s DESC, vec_id LIMIT 50"""
)
def rank_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()["embedding"]
    return vectors.rank_by_similarity(e, list(first), "embedding", "vec_id", 50).select("vec_id", F.round("score", 6).alias("score"))


@query(ORACLE_SQL["learn_profile"])
def profile_round_trip(spark, sf_dir):
    """A learned profile saved and loaded again."""
    import uuid

    from .shared import shared_folder

    path = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    profiles.save_profile(learn_profile(spark, sf_dir), path)
    kept = profiles.load_profile(spark, path)
    return spark.createDataFrame([tuple(kept.values())], profiles.PROFILE)
