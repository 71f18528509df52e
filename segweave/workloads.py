"""The test tables seen as the engine's model, and the queries over them, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import economics as E
from .functions import exprs as X
from .operators import transforms, vectors
from .operators.memory import Memory
from .plans import engine, passes, planner
from .plans.passes import Context
from .plans.segments import KEY, positioned, segment
from .session import table
from .sources import requests
from .streaming import monitors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TASK = "find thonne anblewh and the stable oner handat token"
#: Words that the alert query looks for beside the fixed ones, which the invented texts lack.
MORE_ALERTS = ["stupid", "trash", "worthless"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with the SQL of the same result where SQL can state it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def conv_segments(spark: SparkSession, sf_dir: str, reasoning: bool = False) -> DataFrame:
    """A session for each conversation; with reasoning, what the assistant says counts as its reasoning."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", "text", "turn")
    kind = F.when(F.col("role") == "system", "system_prompt")
    kind = kind.when(F.col("role") == "assistant", "reasoning_trace") if reasoning else kind
    return segment(positioned(c.withColumn("kind", kind.otherwise("conversation_turn")), "turn"))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each source of documents; its documents are reads of one file for each language."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), "doc_id", F.lit("tool").alias("role"), F.lit("file_read").alias("kind"), F.col("lang").alias("path"), "text")
    return segment(positioned(d, "doc_id"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user; its events are outputs of a tool for each type."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id", F.lit("tool").alias("role"), F.lit("tool_output").alias("kind"), F.col("event_type").alias("tool_class"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return segment(positioned(e, "ts", "event_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user: output tokens and cache hit rate of each turn, from its events' ids."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    t = positioned(e, "ts", "event_id").select("session_id", F.col("position").cast("int").alias("turn"), "event_id")
    return t.select("session_id", "turn", (F.col("event_id") * 37 % 401 + 40).alias("output_tokens"), ((F.col("event_id") * 13 % 100) / 100.0).alias("hit_rate"))


CONV = """conv AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seg_id, role, text,
  CASE WHEN role = 'system' THEN 'system_prompt' ELSE 'conversation_turn' END AS kind, (length(text) + 3) // 4 AS token_count FROM conversations)"""
DOCS = """docs AS (SELECT source AS session_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seg_id, lang AS path, text,
  (length(text) + 3) // 4 AS token_count FROM documents)"""
EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_id, event_type AS tool_class,
  event_type || ' ' || props AS text, (length(event_type || ' ' || props) + 3) // 4 AS token_count FROM events)"""
TURNS = """t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS turn,
  event_id * 37 % 401 + 40 AS output_tokens, (event_id * 13 % 100) / 100.0 AS hit_rate FROM events)"""
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SYMBOLS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_./-]{{2,}}'), lambda s: {1}), lambda s: s NOT IN ({2})))".format("{0}", LOW.format("s"), ", ".join(f"'{w}'" for w in X.SYMBOL_STOP_WORDS))
WANTED = sorted(transforms.symbols_of(TASK))
WANTED_SQL = ", ".join(f"'{w}'" for w in WANTED)


def _symbols_sql(text: str) -> str:
    return SYMBOLS.replace("{0}", text).replace("{{", "{").replace("}}", "}")


# scalar expressions


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS INTEGER) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query(f"WITH {CONV} SELECT kind, CASE kind WHEN 'system_prompt' THEN 'frozen' ELSE 'fast' END AS mutation_class, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM conv GROUP BY kind")
def kind_mutation_class(spark, sf_dir):
    return conv_segments(spark, sf_dir).groupBy("kind", "mutation_class").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({_symbols_sql('text')}) AS INTEGER) AS n_symbols FROM documents")
def symbol_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.symbols(F.col("text"))).alias("n_symbols"))


@query(f"SELECT symbol, count(*) AS n FROM (SELECT unnest({_symbols_sql('text')}) AS symbol FROM documents) GROUP BY symbol ORDER BY n DESC, symbol LIMIT 100")
def top_symbols(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.explode(X.symbols(F.col("text"))).alias("symbol"))
    return s.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(100)


@query(
    r"""SELECT page_id, CAST(len(regexp_extract_all(url, '(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+|/[A-Za-z0-9_./-]+')) AS INTEGER) AS paths,
  CAST(len(regexp_extract_all(url, ':[0-9]+(?::[0-9]+)?\b')) AS INTEGER) AS line_numbers, CAST(len(regexp_extract_all(url, '\b[EC][0-9]{3,5}\b')) AS INTEGER) AS error_codes,
  CAST(len(regexp_extract_all(url, '\b[0-9]+\b')) AS INTEGER) AS numbers, CAST(len(regexp_extract_all(url, '\bnull\b|""|''''')) AS INTEGER) AS nulls FROM pages"""
)
def protected_ascii_counts(spark, sf_dir):
    names = {"paths": "path", "line_numbers": "line_number", "error_codes": "error_code", "numbers": "numeric_literal", "nulls": "null_vs_empty"}
    return table(spark, sf_dir, "pages").select("page_id", *[X.protected_count(F.col("url"), kind).alias(n) for n, kind in names.items()])


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches({LOW.format('line')}, 'error|fail|critical|fatal|warn|exception|denied|timeout|stupid|trash|worthless') GROUP BY doc_id")
def alert_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.lines_of(F.col("text"))).alias("line"))
    return lines.where(X.contains_any(F.col("line"), [*X.ALERTS, *MORE_ALERTS])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    """SELECT item_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN 3 WHEN regexp_matches(w, '^\\p{Lu}') AND octet_length(encode(w)) > 2 THEN 2
  WHEN octet_length(encode(w)) >= 8 THEN 1 ELSE 0 END)), 0) AS INTEGER) AS score FROM benchmark"""
)
def salience_scores(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.salience(F.col("text")).alias("score"))


@query("SELECT item_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS short FROM benchmark")
def truncate_field(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.truncate(F.col("text"), 60).alias("short"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'search') AND (event_id % 3 = 0 OR event_id % 3 = 1) THEN CASE WHEN event_type = 'search' THEN 'src/auth/jwt.rs' ELSE CASE event_id % 3 WHEN 1 THEN '.' END END
  ELSE CASE event_id % 3 WHEN 1 THEN '.' WHEN 2 THEN 'src' END END AS path FROM events"""
)
def narrow_tool_call(spark, sf_dir):
    scope = F.when(F.col("event_id") % 3 == 1, ".").when(F.col("event_id") % 3 == 2, "src")
    wanted = F.array(*[F.lit(s) for s in sorted(transforms.symbols_of("fix the auth bug in src/auth/jwt.rs or src/a"))])
    return table(spark, sf_dir, "events").select("event_id", X.narrowed_path(F.col("event_type"), scope, wanted).alias("path"))


@query(
    """SELECT provider, n AS turns, round(CAST((w - 1) / (w - r) AS DOUBLE), 6) AS floor, n > w / (0.6 * r) AS amortised, 300 * r * n > 700 * w AS bust
  FROM (VALUES ('anthropic_5m', 1.25, 0.1), ('anthropic_1h', 2.0, 0.1), ('openai', 1.0, 0.1)) p(provider, w, r), range(1, 101) t(n)"""
)
def cache_economics(spark, sf_dir):
    w, r, n = F.col("write_mult"), F.col("read_mult"), F.col("turns")
    rows = E.cache_models(spark).select("provider", "write_mult", "read_mult", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))).alias("turns"))
    return rows.select("provider", "turns", F.round(E.hit_rate_floor(w, r), 6).alias("floor"), E.amortised(w, r, F.lit(0.4), n).alias("amortised"), E.bust_pays(w, r, F.lit(1000), F.lit(700), n).alias("bust"))


@query(
    """SELECT event_id, CAST(CASE WHEN f >= 0.8 THEN 3 WHEN f >= 0.5 THEN 2 ELSE 1 END - s AS INTEGER) AS level,
  list_extract(['backoff', 'default', 'tighten', 'lossy'], CASE WHEN f >= 0.8 THEN 3 WHEN f >= 0.5 THEN 2 ELSE 1 END - s + 1) AS label
  FROM (SELECT event_id, event_id % 200000 / 200000.0 AS f, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS s FROM (SELECT event_id * 6151 AS event_id FROM events))"""
)
def controller_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 6151).alias("event_id"))
    c = E.controller(F.col("event_id") % 7 == 0, E.context_fill(F.col("event_id") % 200_000))
    return e.select("event_id", c.alias("c")).select("event_id", "c.level", "c.label")


@query("SELECT o_orderkey, o_orderkey % 10000 / 10000.0 < 0.1 AS held_out FROM orders")
def holdout_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.holdout(F.col("o_orderkey"), 0.1).alias("held_out"))


@query(
    """SELECT event_id, CAST(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS BIGINT) AS first, list_max(list_transform(regexp_extract_all(props || props, '"k"\\s*:\\s*(\\d+)', 1), lambda x: CAST(x AS BIGINT))) AS largest FROM events"""
)
def usage_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.first_number(F.col("props"), "k").alias("first"), X.largest_number(F.concat("props", "props"), "k").alias("largest"))


# passes


@query(f"WITH {EVENTS} SELECT session_id, seg_id FROM (SELECT *, max(seg_id) OVER (PARTITION BY session_id, tool_class) AS latest FROM ev) WHERE seg_id < latest")
def supersession(spark, sf_dir):
    return passes.supersession(event_segments(spark, sf_dir), Context()).select(*KEY)


@query(f"WITH {EVENTS}, reg AS (SELECT DISTINCT session_id, tool_class, 5 AS latest_turn FROM ev WHERE tool_class < 'm') SELECT e.session_id, e.seg_id FROM (SELECT *, max(seg_id) OVER (PARTITION BY session_id, tool_class) AS latest FROM ev) e LEFT JOIN reg r ON e.session_id = r.session_id AND e.tool_class = r.tool_class WHERE e.seg_id < latest OR coalesce(latest_turn > e.seg_id, false)")
def registry_supersession(spark, sf_dir):
    s = event_segments(spark, sf_dir)
    registry = s.where("tool_class < 'm'").select("session_id", "tool_class").distinct().withColumn("latest_turn", F.lit(5))
    return passes.supersession(s, Context(registry=registry)).select(*KEY)


@query(f"WITH {DOCS} SELECT session_id, seg_id FROM (SELECT session_id, seg_id, row_number() OVER (PARTITION BY session_id, text ORDER BY seg_id) AS n FROM docs) WHERE n > 1")
def exact_dedup(spark, sf_dir):
    return passes.exact_dedup(doc_segments(spark, sf_dir), Context()).select(*KEY)


@query(f"WITH {DOCS} SELECT session_id, path, min(seg_id) AS base_id FROM docs GROUP BY session_id, path")
def ivm_bases(spark, sf_dir):
    return passes.file_bases(doc_segments(spark, sf_dir)).select("session_id", "path", "base_id")


@query(f"WITH {DOCS} SELECT session_id, seg_id, row_number() OVER (PARTITION BY session_id, path ORDER BY seg_id) - 1 AS version FROM docs")
def file_versions(spark, sf_dir):
    version = F.row_number().over(Window.partitionBy("session_id", "path").orderBy("position")) - 1
    return doc_segments(spark, sf_dir).select(*KEY, version.cast("long").alias("version"))


@query(
    f"""WITH {CONV} SELECT session_id, seg_id FROM (SELECT *, max(seg_id) OVER (PARTITION BY session_id) AS last FROM conv) WHERE role = 'assistant' AND last - seg_id >= 3
  AND NOT regexp_matches({LOW.format("text")}, '{"|".join(X.CONCLUSIONS)}')"""
)
def reasoning_prune(spark, sf_dir):
    return passes.reasoning_prune(conv_segments(spark, sf_dir, reasoning=True), Context()).select(*KEY)


@query(f"WITH {DOCS} SELECT DISTINCT session_id, seg_id FROM (SELECT session_id, seg_id, unnest({_symbols_sql('text')}) AS symbol FROM docs) WHERE symbol IN ({WANTED_SQL})")
def relevance_direct(spark, sf_dir):
    known = passes.segment_symbols(doc_segments(spark, sf_dir))
    return known.where(F.col("symbol").isin(WANTED)).select(*KEY).distinct()


@query(f"WITH {DOCS} SELECT session_id, seg_id, last - seg_id < 6 AS recent FROM (SELECT *, max(seg_id) OVER (PARTITION BY session_id) AS last FROM docs)")
def recency_window(spark, sf_dir):
    s = doc_segments(spark, sf_dir)
    return s.join(passes.last_positions(s), "session_id").select(*KEY, (F.col("last_position") - F.col("position") < 6).alias("recent"))


@query(f"WITH {CONV} SELECT session_id, seg_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE kind WHEN 'system_prompt' THEN 0 ELSE 2 END, seg_id) - 1 AS ordinal FROM conv")
def stability_order(spark, sf_dir):
    s = conv_segments(spark, sf_dir)
    return planner.emit(s, planner.resolve(s, [])).select(*KEY, F.col("ordinal").cast("long").alias("ordinal"))


_RESOLVED = f"""{DOCS}, d AS (SELECT session_id, seg_id FROM (SELECT session_id, seg_id, row_number() OVER (PARTITION BY session_id, text ORDER BY seg_id) AS n FROM docs) WHERE n > 1),
  r AS (SELECT session_id, seg_id, last - seg_id >= 6 AS old FROM (SELECT *, max(seg_id) OVER (PARTITION BY session_id) AS last FROM docs)),
  m AS (SELECT DISTINCT session_id, seg_id FROM (SELECT session_id, seg_id, unnest({_symbols_sql("text")}) AS symbol FROM docs) WHERE symbol IN ({WANTED_SQL})),
  p AS (SELECT x.session_id, x.seg_id, x.token_count, CASE WHEN r.old AND m.seg_id IS NULL THEN 'irrelevant' WHEN d.seg_id IS NOT NULL THEN 'duplicate' END AS reason
   FROM docs x JOIN r USING (session_id, seg_id) LEFT JOIN d USING (session_id, seg_id) LEFT JOIN m USING (session_id, seg_id))"""


def _direct(segments: DataFrame, ctx: Context) -> DataFrame:
    """Older segments that don't share a symbol with the task themselves."""
    known = passes.segment_symbols(segments).where(F.col("symbol").isin(WANTED)).select(*KEY).distinct()
    return passes._proposal(passes.older(segments, segments.select(*KEY, "position"), 6).join(known, KEY, "left_anti"), "drop", "irrelevant")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = doc_segments(spark, sf_dir)
    return planner.resolve(s, [passes.exact_dedup(s, Context()), _direct(s, Context())])


@query(f"WITH {_RESOLVED} SELECT session_id, seg_id, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS action, reason FROM p")
def proposal_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select(*KEY, "action", "reason")


@query(
    f"""WITH {_RESOLVED} SELECT session_id, CAST(sum(token_count) AS BIGINT) AS input_tokens, CAST(coalesce(sum(token_count) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS net_tokens, count(*) FILTER (WHERE reason IS NULL) AS kept,
  count(*) FILTER (WHERE reason IS NOT NULL) AS dropped, CAST(0 AS BIGINT) AS replaced, round(coalesce(sum(token_count) FILTER (WHERE reason IS NULL), 0) / sum(token_count), 6) AS ratio FROM p GROUP BY session_id"""
)
def net_tokens_report(spark, sf_dir):
    return planner.report(_resolved(spark, sf_dir))


# eviction

_FREQ = f"""{CONV}, sym AS (SELECT session_id, seg_id, unnest({_symbols_sql("text")}) AS symbol FROM conv),
  freq AS (SELECT a.session_id, a.seg_id, count(DISTINCT b.seg_id) - 1 AS frequency FROM sym a JOIN sym b USING (session_id, symbol) GROUP BY a.session_id, a.seg_id)"""


@query(f"WITH {_FREQ} SELECT session_id, seg_id, frequency FROM freq")
def coref_frequency(spark, sf_dir):
    return planner.coreference(passes.segment_symbols(conv_segments(spark, sf_dir)))


_PRIO = f"""{_FREQ}, need AS (SELECT DISTINCT session_id, seg_id FROM sym WHERE symbol IN ({WANTED_SQL})),
  prio AS (SELECT c.*, CASE WHEN n.seg_id IS NULL THEN 0 ELSE 1 END AS future_need, coalesce(frequency, 0) AS frequency, (CASE WHEN n.seg_id IS NULL THEN 0 ELSE 1 END) * 1000000000 + coalesce(frequency, 0) * 100000 + c.seg_id AS priority
  FROM conv c LEFT JOIN need n USING (session_id, seg_id) LEFT JOIN freq f USING (session_id, seg_id))"""


@query(f"WITH {_PRIO} SELECT session_id, seg_id, future_need, CAST(priority AS BIGINT) AS priority FROM prio")
def future_need(spark, sf_dir):
    return planner.priorities(conv_segments(spark, sf_dir), TASK).select(*KEY, "future_need", F.col("priority").cast("long").alias("priority"))


_EVICT = """{prio}, tot AS (SELECT session_id, sum(token_count) AS net, {budget} AS budget FROM conv GROUP BY session_id),
  c AS (SELECT p.session_id, p.seg_id, net, budget, coalesce(sum(token_count) OVER (PARTITION BY p.session_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM prio p JOIN tot USING (session_id) WHERE kind <> 'system_prompt')"""


@query(f"WITH {_EVICT.format(prio=_PRIO, budget=120)} SELECT session_id, seg_id FROM c WHERE net > budget AND net - before > budget")
def evict_to_budget(spark, sf_dir):
    s = conv_segments(spark, sf_dir)
    return planner.dropped(planner.evict(s, planner.resolve(s, []), TASK, 120)).select(*KEY)


@query(f"WITH {_EVICT.format(prio=_PRIO, budget='greatest(60, CAST(ceil(sum(token_count) * 0.5) AS BIGINT))')} SELECT session_id, seg_id FROM c WHERE net > budget AND net - before > budget")
def quality_floor(spark, sf_dir):
    s = conv_segments(spark, sf_dir)
    return planner.dropped(planner.evict(s, planner.resolve(s, []), TASK, 60, floor=0.5)).select(*KEY)


@query(f"WITH {CONV} SELECT session_id, seg_id FROM (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seg_id DESC) AS upto, max(seg_id) OVER (PARTITION BY session_id) AS last FROM conv) WHERE upto <= 120 OR seg_id = last")
def naive_truncation(spark, sf_dir):
    return planner.naive_truncation(conv_segments(spark, sf_dir), 120)


# statistics behind the encodings


def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every hundred orders as one JSON array."""
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 100).alias("blob")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("blob", F.to_json("rows").alias("text"))


# lossy transforms


@query()
def lossy_compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", transforms.lossy_udf(3, TASK, 200, 40)("text").alias("compact"))


# vectors and memory


@query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * (SELECT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings")
def cosine_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()["embedding"]
    return e.select("vec_id", F.round(X.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first])), 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS size FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.norm(F.col("embedding")), 6).alias("size"))


@query()
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", vectors.embedder()("text").alias("embedding"))


@query()
def rank_by_relevance(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("embedding", vectors.embedder(bigrams=0.5)("text"))
    return vectors.rank_by_similarity(rows, vectors.hash_embedding(TASK, bigrams=0.5).tolist(), "embedding", "item_id")


def part_memory(spark: SparkSession, sf_dir: str) -> Memory:
    """Names of parts as contents, brands as their sources."""
    items = table(spark, sf_dir, "part").select(F.col("p_type").alias("content"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("ord"))
    return Memory.empty(spark).remember(items)


_MEM = "mem AS (SELECT row_number() OVER (ORDER BY min(p_partkey)) AS id, p_type AS content FROM part GROUP BY p_type), src AS (SELECT DISTINCT id AS memory_id, p_brand AS source FROM part JOIN mem ON p_type = content)"


@query(f"WITH {_MEM} SELECT id, content FROM mem")
def memory_remember(spark, sf_dir):
    return part_memory(spark, sf_dir).memories.select("id", "content")


_WORDS = "standard brushed tin"


@query(
    f"""WITH {_MEM}, s AS (SELECT id, content, {" + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in _WORDS.split())} AS score FROM mem)
  SELECT id, content, score, coalesce((SELECT string_agg(source, ', ' ORDER BY source) FROM src WHERE memory_id = id), '') AS sources FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 20)"""
)
def memory_recall(spark, sf_dir):
    return part_memory(spark, sf_dir).recall(_WORDS, 20)


@query(f"WITH {_MEM} SELECT id, content FROM mem ORDER BY id DESC LIMIT 10")
def memory_recent(spark, sf_dir):
    return part_memory(spark, sf_dir).recall("", 10).select("id", "content")


@query("SELECT count(DISTINCT p_type) AS memories, count(DISTINCT p_brand) AS sources FROM part")
def memory_stats(spark, sf_dir):
    return part_memory(spark, sf_dir).stats()


@query(f"WITH {_MEM} SELECT id, content FROM mem WHERE id % 3 <> 0")
def memory_forget(spark, sf_dir):
    m = part_memory(spark, sf_dir)
    return m.forget(m.memories.where("id % 3 = 0").select("id")).memories.select("id", "content")


# monitors and statistics


_HALTED = f"""g AS (SELECT *, sum(CASE WHEN hit_rate >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS island FROM t),
  r AS (SELECT *, sum(CASE WHEN hit_rate < 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY turn) AS below FROM g),
  h AS (SELECT session_id, turn, max(CASE WHEN below >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) = 1 AS halted FROM r)"""
_SPIKES = """f AS (SELECT session_id, turn, CAST(output_tokens AS DOUBLE) AS baseline, 0 AS run, false AS spiking FROM t WHERE turn = 0
  UNION ALL SELECT session_id, turn, CASE WHEN over AND NOT shifted THEN baseline ELSE 0.3 * o + 0.7 * baseline END, run, over AND NOT shifted FROM
   (SELECT *, over AND run >= 5 AS shifted FROM (SELECT f.session_id, t.turn, CAST(t.output_tokens AS DOUBLE) AS o, f.baseline, t.turn >= 2 AND t.output_tokens > f.baseline * 1.75 AS over, CASE WHEN t.turn >= 2 AND t.output_tokens > f.baseline * 1.75 THEN f.run + 1 ELSE 0 END AS run
     FROM f JOIN t ON t.session_id = f.session_id AND t.turn = f.turn + 1)))"""


@query(f"WITH RECURSIVE {TURNS}, {_SPIKES}, {_HALTED} SELECT h.session_id, h.turn, halted, spiking FROM h JOIN f ON h.session_id = f.session_id AND h.turn = f.turn")
def monitor_stream(spark, sf_dir):
    """Both monitors as one stream with state, over all turns."""
    import uuid

    from .shared import shared_folder

    t = turns(spark, sf_dir).withColumn("hit_rate", F.col("hit_rate").cast("double"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    t.write.parquet(f"{path}/in")
    stream = monitors.monitor_stream(spark.readStream.schema(t.schema).parquet(f"{path}/in"), 0.6)
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(
    f"""WITH {TURNS}, g AS (SELECT *, sum(CASE WHEN hit_rate >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS island FROM t),
  r AS (SELECT *, sum(CASE WHEN hit_rate < 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY turn) AS below FROM g)
  SELECT session_id, turn, CAST(below AS INTEGER) AS below_run, max(CASE WHEN below >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) = 1 AS halted FROM r"""
)
def hit_rate_streak(spark, sf_dir):
    return monitors.halted_turns(turns(spark, sf_dir), 0.6).select("session_id", "turn", "below_run", "halted")


@query(
    f"""WITH RECURSIVE {TURNS}, f AS (SELECT session_id, turn, CAST(output_tokens AS DOUBLE) AS baseline, 0 AS run, false AS spiking FROM t WHERE turn = 0
  UNION ALL SELECT session_id, turn, CASE WHEN over AND NOT shifted THEN baseline ELSE 0.3 * o + 0.7 * baseline END, run, over AND NOT shifted FROM
   (SELECT *, over AND run >= 5 AS shifted FROM (SELECT f.session_id, t.turn, CAST(t.output_tokens AS DOUBLE) AS o, f.baseline, t.turn >= 2 AND t.output_tokens > f.baseline * 1.75 AS over, CASE WHEN t.turn >= 2 AND t.output_tokens > f.baseline * 1.75 THEN f.run + 1 ELSE 0 END AS run
     FROM f JOIN t ON t.session_id = f.session_id AND t.turn = f.turn + 1)))
  SELECT session_id, turn, CAST(floor(baseline * 1000 + 0.3337) AS BIGINT) AS baseline_thousandths, spiking FROM f"""
)
def ewma_spikes(spark, sf_dir):
    return monitors.spiking_turns(turns(spark, sf_dir)).select("session_id", "turn", F.floor(F.col("baseline") * 1000 + 0.3337).alias("baseline_thousandths"), "spiking")


@query(
    """WITH a AS (SELECT count(*) FILTER (WHERE NOT h) AS ns, sum(p) FILTER (WHERE NOT h) AS ts, count(*) FILTER (WHERE h) AS nh, sum(p) FILTER (WHERE h) AS th FROM (SELECT o_orderkey % 10000 / 10000.0 < 0.1 AS h, o_custkey % 900 + 100 AS p FROM orders)),
  b AS (SELECT 1 - (ts / ns) / (th / nh) AS cut, 1.96 * sqrt(ts / ns / ns / pow(th / nh, 2) + pow(ts / ns, 2) / pow(th / nh, 4) * (th / nh / nh)) AS m FROM a)
  SELECT round(cut * 100, 6) AS reduction_pct, round((cut - m) * 100, 6) AS ci_lo_pct, round((cut + m) * 100, 6) AS ci_hi_pct FROM b"""
)
def output_savings_ci(spark, sf_dir):
    h, p = X.holdout(F.col("o_orderkey"), 0.1), F.col("o_custkey") % 900 + 100
    arms = table(spark, sf_dir, "orders").agg(F.count_if(~h).alias("ns"), F.sum(F.when(~h, p)).alias("ts"), F.count_if(h).alias("nh"), F.sum(F.when(h, p)).alias("th"))
    return arms.select(*[F.round(c, 6).alias(n) for n, c in E.output_reduction(*(F.col(x) for x in ("ns", "ts", "nh", "th"))).items()])


@query(
    f"""WITH {CONV}, k AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seg_id DESC) <= 120 OR seg_id = max(seg_id) OVER (PARTITION BY session_id) AS kept FROM conv),
  s AS (SELECT session_id, 'none' AS name, sum(token_count) AS input, sum(token_count) AS net FROM k GROUP BY session_id UNION ALL SELECT session_id, 'truncation', sum(token_count), sum(token_count) FILTER (WHERE kept) FROM k GROUP BY session_id)
  SELECT name, count(*) AS items, round(avg(net / input), 6) AS ratio FROM s GROUP BY name"""
)
def leaderboard(spark, sf_dir):
    s = conv_segments(spark, sf_dir)
    kept = planner.naive_truncation(s, 120).withColumn("kept", F.lit(True))
    sums = s.join(kept, KEY, "left").groupBy("session_id").agg(F.sum("token_count").alias("input"), F.sum(F.when(F.col("kept"), F.col("token_count"))).alias("short"))
    names = sums.select("input", F.inline(F.array(F.struct(F.lit("none").alias("name"), F.col("input").alias("net")), F.struct(F.lit("truncation").alias("name"), F.col("short").alias("net")))))
    return names.groupBy("name").agg(F.count("*").alias("items"), F.round(F.avg(X.ratio(F.col("net"), F.col("input"))), 6).alias("ratio"))


@query("SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, CAST(max(n_chars) AS BIGINT) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def ratio_percentiles(spark, sf_dir):
    p = E.interpolated(F.col("n_chars"), [0.5, 0.9])
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(p.alias("p"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return rows.select("lang", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p90"), "most", "mean")


@query("SELECT conv_id, max_by(text, turn) AS task FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_text(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", "text")
    return requests.last_user_text(m).withColumnRenamed("session_id", "conv_id")


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE 2 END AS rank, text FROM conversations) SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank, turn) AS context FROM c GROUP BY conv_id")
def joined_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", "text", "turn")
    s = segment(positioned(c.withColumn("kind", F.when(F.col("role") == "system", "system_prompt").otherwise("conversation_turn")), "turn"))
    out = planner.joined_context(planner.emit(s, planner.resolve(s, [])))
    return out.select(F.col("session_id").cast("long").alias("conv_id"), "context")


# whole pipelines


def mixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and, in sessions of their own, users' events."""
    return conv_segments(spark, sf_dir, reasoning=True).withColumn("session_id", F.concat(F.lit("c"), "session_id")).unionByName(event_segments(spark, sf_dir).withColumn("session_id", F.concat(F.lit("u"), "session_id")))


def anthropic_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each user: a tool use and its result for each event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type", "props")
    use = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("tool_use").alias("type"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.struct(F.col("props").alias("q")).alias("input"))).alias("content")))
    result = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.col("event_id").cast("string").alias("tool_use_id"), F.concat_ws(" ", "event_type", "props").alias("content"))).alias("content")))
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.concat(use, F.lit(","), result).alias("m"))))
    return e.groupBy("session_id").agg(F.concat(F.lit('{"messages":['), F.array_join(F.transform(listed, lambda x: x["m"]), ","), F.lit("]}")).alias("body"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(n AS INTEGER) AS position, event_type AS tool_class, event_type || ' ' || props AS text FROM e")
def anthropic_roundtrip(spark, sf_dir):
    return requests.anthropic_tool_results(anthropic_bodies(spark, sf_dir)).select("session_id", "position", "tool_class", "text")


def openai_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "event_type", "props")
    call = F.struct(F.col("event_id").cast("string").alias("id"), F.struct(F.col("event_type").alias("name"), F.lit('{"path":"src/a.rs"}').alias("arguments")).alias("function"))
    use = F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(F.lit("tool").alias("role"), F.col("event_id").cast("string").alias("tool_call_id"), F.concat_ws(" ", "event_type", "props").alias("content")))
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.concat(use, F.lit(","), result).alias("m"))))
    return e.groupBy("session_id").agg(F.concat(F.lit('{"messages":['), F.array_join(F.transform(listed, lambda x: x["m"]), ","), F.lit("]}")).alias("body"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(n AS INTEGER) AS position, event_type AS tool_class, 'src/a.rs' AS path, event_type || ' ' || props AS text FROM e")
def openai_roundtrip(spark, sf_dir):
    return requests.openai_tool_results(openai_bodies(spark, sf_dir)).select("session_id", "position", "tool_class", "path", "text")


_KEPT = f"""{CONV}, k AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seg_id DESC) <= 120 OR seg_id = max(seg_id) OVER (PARTITION BY session_id) AS kept FROM conv),
  x AS (SELECT session_id, string_agg(text, chr(10)) FILTER (WHERE kept) AS context FROM k GROUP BY session_id), n AS (SELECT session_id, max_by(text, seg_id) AS needle FROM conv WHERE role = 'user' GROUP BY session_id)"""


@query(f"WITH {_KEPT} SELECT count(*) AS items, round(avg(CASE WHEN contains(context, needle) THEN 1.0 ELSE 0.0 END), 6) AS fidelity FROM x JOIN n USING (session_id)")
def needle_fidelity(spark, sf_dir):
    """How often what was asked last survives truncation."""
    s = conv_segments(spark, sf_dir)
    context = planner.joined_context(planner.emit(s.join(planner.naive_truncation(s, 120), KEY, "left_semi"), planner.resolve(s, [])))
    needles = s.where("role = 'user'").groupBy("session_id").agg(F.max_by("text", "position").alias("needle"))
    found = F.contains("context", "needle").cast("double")
    return context.join(needles, "session_id").agg(F.count("*").alias("items"), F.round(F.avg(found), 6).alias("fidelity"))


@query(f"WITH {EVENTS} SELECT session_id, tool_class, max(seg_id)::INTEGER AS latest_turn FROM ev GROUP BY ALL")
def session_registry(spark, sf_dir):
    """Runs known after two turns' segments of each session have been recorded."""
    s = event_segments(spark, sf_dir)
    state = engine.SessionState.empty(spark).after(s.where("position % 2 = 0")).after(s.where("position % 2 = 1"))
    return state.registry


@query(f"WITH {DOCS} SELECT session_id, path, max_by(text, seg_id) AS text, count(*) - 1 AS version FROM docs GROUP BY session_id, path")
def session_files(spark, sf_dir):
    return engine.SessionState.empty(spark).after(doc_segments(spark, sf_dir)).files


@query(f"WITH {CONV} SELECT session_id, sha256(string_agg(text, chr(31) ORDER BY seg_id)) AS prefix_hash FROM conv WHERE kind = 'system_prompt' GROUP BY session_id")
def frozen_prefix(spark, sf_dir):
    return engine.frozen_prefix(conv_segments(spark, sf_dir))


@query()
def embedding_salience(spark, sf_dir):
    return passes.embedding_salience(doc_segments(spark, sf_dir), Context(TASK)).select(*KEY)


@query("SELECT event_id, round(hit, 6) AS hit FROM (SELECT event_id, (event_id % 90) / nullif((event_id % 90) + (event_id % 7), 0) AS hit FROM events)")
def hit_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(E.hit_rate(F.col("event_id") % 90, F.col("event_id") % 7), 6).alias("hit"))


@query("SELECT item_id, CASE WHEN regexp_matches(ltrim(text), '^[{\\[]') THEN 'json' WHEN regexp_matches(left(text, 50), '[Ee]rror') OR ((length(text) + 3) // 4 < 30 AND NOT contains(left(text, 40), chr(10))) THEN 'error_short' WHEN regexp_matches(ltrim(text), '^(#|The |This |I |We |To |In )') THEN 'prose' ELSE 'other' END AS category FROM benchmark")
def output_categories(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.output_category(F.col("text")).alias("category"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the structural and query passes over documents as sessions of file reads."""
    return planner.report(planner.make_plan(doc_segments(spark, sf_dir), TASK))
