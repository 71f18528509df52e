import json

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segweave.functions import exprs as X
from segweave.gateway_queries import board_items, leaderboard_of
from segweave.operators import statistics, tools
from segweave.plans import engine, gateway, passes, planner
from segweave.plans.segments import positioned, ranked, segment
from segweave.queries import ORACLE_SQL, QUERIES
from segweave.sources import requests as R

TURNS = "session_id string, body string, halted boolean, spiking boolean"


def result(id_, text, **more):
    return {"role": "user", "content": [{"type": "tool_result", "tool_use_id": id_, "content": text, **more}]}


def use(id_, name, **arguments):
    return {"role": "assistant", "content": [{"type": "tool_use", "id": id_, "name": name, "input": arguments}]}


def body(*messages, **more):
    return json.dumps({"messages": list(messages), **more})


def sent(spark, rows, provider="anthropic", config=gateway.Config()):
    bodies, reports = gateway.compress_requests(spark.createDataFrame(rows, TURNS), provider, config)
    return {r.session_id: r.body for r in bodies.collect()}, {r.session_id: r for r in reports.collect()}


def texts(raw):
    return [m["content"] if isinstance(m["content"], str) else m["content"][0]["content"] for m in json.loads(raw)["messages"] if m["role"] in ("user", "tool")]


LOG = "build ok " + "x" * 200


def test_stale_runs_give_way_and_the_cached_prefix_stays(spark):
    plain = body(use("a", "build"), result("a", LOG + "1"), use("b", "build"), result("b", LOG + "2"))
    marked = body(use("a", "build"), result("a", LOG + "1", cache_control={"type": "ephemeral"}), use("b", "build"), result("b", LOG + "2"), use("c", "build"), result("c", LOG + "3"))
    whole = json.loads(marked)
    whole["messages"][1].pop("cache_control", None)
    whole["messages"][3]["cache_control"] = {"type": "ephemeral"}
    got, reports = sent(spark, [("plain", plain, False, False), ("marked", marked, False, False), ("message", json.dumps(whole), False, False)])
    assert texts(got["plain"]) == ["[tool output elided — superseded]", LOG + "2"]
    assert texts(got["marked"]) == [LOG + "1", "[tool output elided — superseded]", LOG + "3"]
    # The mark of a message covers all of it: one result is left, which nothing supersedes.
    assert got["message"] == json.dumps(whole)
    assert reports["plain"].dropped == 1 and reports["plain"].net_tokens < reports["plain"].input_tokens and reports["plain"].aggression == "default"


def test_array_results_and_texts_that_look_like_arrays(spark):
    parts = [{"type": "text", "text": LOG}, {"type": "image", "data": "x"}, {"type": "text", "text": "[1, 2]"}]
    raw = body(use("a", "ls"), result("a", parts), use("b", "ls"), result("b", "[1, 2, 3]"))
    found = R.anthropic_tool_results(spark.createDataFrame([("s", raw)], "session_id string, body string")).orderBy("position").collect()
    assert [(r.inner, r.text) for r in found] == [(0, LOG), (2, "[1, 2]"), (0, "[1, 2, 3]")]
    got, _ = sent(spark, [("s", raw, False, False)])
    first = json.loads(got["s"])["messages"][1]["content"][0]["content"]
    assert [p.get("text") for p in first] == ["[tool output elided — superseded]", None, "[tool output elided — superseded]"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_and_plans_broadcast_nothing(spark):
    """Repeated texts pack into small files, from which the engine would take millions of segments for a few megabytes."""
    rows = [("s", i, "tool", kind, f"c{i % 2}", path, f"text {i % 3}\nof some lines") for i in range(9) for kind, path in [("file_read", "a.rs") if i % 2 else ("tool_output", None)]]
    s = segment(spark.createDataFrame(rows, "session_id string, position int, role string, kind string, tool_class string, path string, text string"))
    how = spark.createDataFrame([("s", "some text", 1)], "session_id string, task string, keep int")
    proposals = [p(s, passes.Context()) for p in passes.STRUCTURAL] + [passes.relevance_by_session(s, how), passes.reasoning_prune(s, passes.Context())]
    assert all("Broadcast" not in plan_of(p) for p in proposals)
    plan = planner.resolve(s, proposals)
    assert "Broadcast" not in plan_of(plan) and "Broadcast" not in plan_of(planner.enforce(s, plan))


def test_a_pass_stands_once_in_the_queries_of_its_plan(spark, monkeypatch):
    """The driver plans and compiles all passes at once; the look for unsound replacements must not bring them in again."""
    queries, write = [], planner.written
    monkeypatch.setattr(planner, "written", lambda df: queries.append(plan_of(df)) or write(df))
    s = segment(spark.createDataFrame([("s", 0, "tool", "tool_output", "c", "a text")], "session_id string, position int, role string, kind string, tool_class string, text string"))
    proposal = spark.range(1).selectExpr("'s' AS session_id", "id AS seg_id", "'replace' AS action", "'duplicate' AS reason", "'x' AS rendered", "1 AS new_tokens", "'delta' AS reconstruct", "id AS base_id")
    plan = planner.enforce(s, planner.resolve(s, [proposal]))
    assert [r.action for r in plan.collect()] == ["keep"]
    assert sum(q.count("Range (") for q in queries) == 1 and "Range (" not in plan_of(plan)


def test_reports_and_their_counts_broadcast_one_row_at_most(spark):
    raw = body(use("a", "build"), result("a", LOG + "1"), use("b", "build"), result("b", LOG + "2"))
    _, reports = gateway.compress_requests(spark.createDataFrame([("s", raw, False, False)], TURNS), "anthropic")
    assert "Broadcast" not in plan_of(reports) and "Broadcast" not in plan_of(gateway.request_tasks(spark.createDataFrame([("s", raw)], "session_id string, body string")))
    responses = spark.createDataFrame([("s", 3, False)], "session_id string, output_tokens long, held_out boolean")
    shown = plan_of(gateway.dashboard(gateway.counters(reports, responses)))
    assert shown.count("BroadcastNestedLoopJoin") == 1 and "BroadcastHashJoin" not in shown


#: Results of a user, of which the first four are cached: none is left of the first, one of the second, none is fresh of the third.
NOTHING_LEFT, ONE_LEFT, ALL_CACHED = (["a", "b", "c", "d", "x", "x"], ["a", "b", "c", "d", "x", "y"], ["a", "b", "c", "d"])


def equal_to_sql(spark, folder, name, users):
    """The rows of a query over events of users (user_id: props), once they are those of its SQL."""
    path = f"{folder}/events.parquet"
    rows = [(100 * user + i, user, "click", p) for user, props in users.items() for i, p in enumerate(props)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.mode("overwrite").parquet(path)
    df = QUERIES[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{path}/*.parquet'")
    found = duck.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})")
    assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr)
    return got


def test_net_tokens_of_nothing_left_are_null(spark, tmp_path):
    got = {r[0]: r[1:4] for r in equal_to_sql(spark, tmp_path, "turn_reports", {1: NOTHING_LEFT, 2: ONE_LEFT, 3: ALL_CACHED})}
    assert got == {"1": (4, None, 2), "2": (4, 2, 1), "3": (None, None, None)}


@pytest.mark.parametrize("users, figures", [({1: NOTHING_LEFT, 2: ONE_LEFT}, (8, 2, 2, 0.75)), ({1: NOTHING_LEFT}, (4, None, None, None)), ({3: ALL_CACHED}, (None, None, None, None))])
def test_figures_of_nothing_left(spark, tmp_path, users, figures):
    [stats] = equal_to_sql(spark, tmp_path, "gateway_stats", users)
    assert (*stats[1:4], stats[10]) == figures
    shown = dict(equal_to_sql(spark, tmp_path, "dashboard", users))
    assert shown["saved"] == (None if figures[3] is None else "75.0%")


def test_bodies_broadcast_nothing(spark):
    raw = body(use("a", "build"), result("a", LOG + "1"), use("b", "build"), result("b", LOG + "2"))
    for least in (0, 150):
        bodies, _ = gateway.compress_requests(spark.createDataFrame([("s", raw, False, False)], TURNS), "anthropic", gateway.Config(least_savings=least))
        assert "Broadcast" not in plan_of(bodies)


def test_openai_results(spark):
    call = lambda i, name: {"role": "assistant", "content": None, "tool_calls": [{"id": i, "function": {"name": name, "arguments": "{}"}}]}
    raw = body(call("a", "ls"), {"role": "tool", "tool_call_id": "a", "content": LOG}, call("b", "ls"), {"role": "tool", "tool_call_id": "b", "content": "new " + LOG}, {"role": "tool", "tool_call_id": "c", "content": [{"type": "text", "text": "kept"}]})
    got, _ = sent(spark, [("s", raw, False, False)], "openai")
    assert [m["content"] for m in json.loads(got["s"])["messages"] if m["role"] == "tool"] == ["[tool output elided — superseded]", "new " + LOG, [{"type": "text", "text": "kept"}]]


def test_what_cannot_be_compressed_passes_to_the_byte(spark):
    raw = body(use("a", "build"), result("a", LOG), use("b", "build"), result("b", LOG))
    rows = [("halted", raw, True, False), ("broken", raw + "}", False, False), ("null", None, False, False), ("spiking", raw, False, True)]
    got, reports = sent(spark, rows)
    assert got["halted"] == raw and got["broken"] == raw + "}" and got["null"] is None and got["spiking"] != raw
    assert {k: (r.aggression, r.input_tokens is None) for k, r in reports.items()} == {"halted": ("halt", True), "broken": ("default", True), "null": ("default", True), "spiking": ("backoff", False)}
    assert set(sent(spark, rows, config=gateway.Config(enabled=False))[0].values()) == {raw, raw + "}", None}
    assert sent(spark, [rows[3]], config=gateway.Config(least_savings=10**6))[0]["spiking"] == raw
    held = sent(spark, [rows[3]], config=gateway.Config(held_out=1.0))
    assert held[0]["spiking"] == raw and held[1]["spiking"].aggression == "holdout"


def test_full_windows_shorten_what_is_kept(spark):
    code = "fn load(x: u32) -> u32 {\n    let a = x;\n    let b = a;\n    b\n}\n"
    rows = "\n".join(chr(97 + i % 26) * (250 + i) for i in range(80))
    raw = body({"role": "user", "content": "fix load"}, use("a", "Read", path="src/a.rs"), result("a", code), use("b", "ls"), result("b", rows))
    got, reports = sent(spark, [("s", raw, False, False)], config=gateway.Config(window=1000))
    kept = texts(got["s"])
    assert reports["s"].aggression == "lossy"
    assert kept[1].startswith(gateway.SKELETON) and "lines hidden" in kept[1]
    assert kept[2].startswith(gateway.SHORTENED) and "…" in kept[2] and len(kept[2]) < len(rows) / 2


def test_settings_change_while_it_runs(spark):
    changes = spark.createDataFrame([(1, "enabled", "0"), (2, "enabled", "yes"), (3, "recency_keep", "4"), (4, "recency_keep", "x4"), (5, "other", "1")], "at int, name string, value string")
    assert gateway.latest_config(changes) == gateway.Config(True, gateway.RECENCY)
    assert gateway.latest_config(changes.where("at in (1, 3)")) == gateway.Config(False, 4)
    assert gateway.latest_config(changes.limit(0)) == gateway.Config()


def test_session_numbers_are_fnv(spark):
    rows = [('{"system":"é","messages":[{"role":"user","content":"x"}]}',), ("{}",), ("[1]",), ("nope",), (None,)]
    got = [r.n for r in spark.createDataFrame(rows, "b string").select(R.session_number(F.col("b")).alias("n")).collect()]
    h = 0xCBF29CE484222325
    for byte in '"é"{"content":"x","role":"user"}'.encode():
        h = ((h ^ byte) * 0x100000001B3) % 2**64
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    assert got == [signed(h), signed(0xCBF29CE484222325), None, None, None]
    n = spark.createDataFrame([(signed(v),) for v in (0, 5, 2**63, 2**64 - 1)], "n long").select(R.unsigned_remainder(F.col("n"), 10_000).alias("r")).collect()
    assert [r.r for r in n] == [v % 10_000 for v in (0, 5, 2**63, 2**64 - 1)]


def test_tools_keep_originals(spark):
    table = "a,b\n" + "\n".join(f"{i},{i}" for i in range(50))
    calls = spark.createDataFrame([("1", "compact_csv", table), ("2", "compact_csv", "short"), ("3", "unknown", "x"), ("4", None, "y"), ("5", "compact_csv", None)], "call_id string, tool string, content string")
    called = {r.call_id: r for r in tools.call_tools(calls).collect()}
    assert called["1"].short and called["1"].result.endswith(f"id={called['1'].id}]") and called["2"].result == "short" and called["3"].result is None and called["5"].result is None
    store = tools.originals(tools.call_tools(calls))
    asked = spark.createDataFrame([(called["1"].id,), ("none",)], "id string")
    got = {r.id: r for r in tools.expand(asked, store).collect()}
    assert got[called["1"].id].text == table and got["none"].text is None and "none" in got["none"].error
    with pytest.raises(PySparkException, match="unknown id none"):
        tools.expand(asked, store, strict=True).collect()
    s = tools.savings(tools.call_tools(calls)).first()
    assert s.saved == s.saved_in - s.saved_out > 0 and s.retrievable == 1
    assert tools.savings(tools.call_tools(calls.limit(0))).first().pct == 0.0


def test_shell_commands_change_nothing_when_they_fail(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    run = lambda command: [r[0] for r in df.select(tools.shell(command)(F.col("t"))).collect()]
    assert run(["tr", "a", "b"]) == ["bb", None] and run(["false"]) == run(["no-such-command"]) == ["ab", None]
    assert tools.probe(["cat"]) and not tools.probe(["no-such-command"])


def test_transcripts(spark, tmp_path):
    line = lambda content: json.dumps({"type": "user", "message": {"content": content}})
    (tmp_path / "a.jsonl").write_text("\n".join([line("first"), "broken {", line([{"type": "text", "text": " asked "}]), line([{"type": "tool_result", "content": "out [1]"}]), line([{"type": "text", "text": "too late"}])]))
    (tmp_path / "b.jsonl").write_text("\n".join([line([{"type": "tool_result", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]), line("x" * 300)]))
    prompts = {r.path[-7:]: r.prompt for r in R.transcript_prompts(spark, str(tmp_path)).collect()}
    assert prompts == {"a.jsonl": "asked", "b.jsonl": "x" * 200}
    results = R.transcript_results(spark, str(tmp_path))
    assert {(r.path[-7:], r.text) for r in results.collect()} == {("a.jsonl", "out [1]"), ("b.jsonl", "p\nq")}
    assert {r.task for r in R.with_prompts(results, R.transcript_prompts(spark, str(tmp_path))).collect()} == {"asked", "x" * 100}


def test_windows_of_a_response(spark):
    text = '{"cache_read_input_tokens": 1, "cache_creation_input_tokens": 2}' + " " * 100 + '"output_tokens": 3, "output_tokens": 30'
    df = spark.createDataFrame([(text,), ('"completion_tokens":7',), ("",), (None,)], "b string")
    got = df.select(X.cache_usage(F.col("b"), 80, 60).alias("u"), X.cache_usage(F.col("b"), 20, 20).alias("v"), X.tail_first_output(F.col("b"), 80, 60).alias("o")).collect()
    assert [None if r.u is None else tuple(r.u) for r in got] == [(1, 2), None, None, None] and all(r.v is None for r in got) and [r.o for r in got] == [30, 7, None, None]


def test_protected_spans_are_where_the_pattern_matches(spark):
    import re

    text = "see src/é/auth.rs:12:4 E1234 null '' and 7"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(X.protected_spans(F.col("t")).alias("s")).collect()
    raw = text.encode()
    for kind, pattern in X.PROTECTED.items():
        want = [(len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(pattern, text)]
        assert [(s.start, s.end) for s in got[0].s if s.kind == kind] == want, kind
    assert raw[got[0].s[0].start : got[0].s[0].end].decode() == "src/é/auth.rs" and got[1].s == []


def test_ranks_in_spans_equal_plain_ranks(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("session_id"), (F.xxhash64("id") % 500).alias("a"), "id")
    plain = {(r.session_id, r.id): r.position for r in ranked(rows, "a", "id").collect()}
    assert plain == {(r.session_id, r.id): r.position for r in ranked(rows, "a", "id", spans=16).collect()}
    text = rows.withColumn("text", F.lit("t"))
    plan = positioned(text, "a", "id")._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "text" not in window


def test_common_lines_bring_no_outputs_together(spark):
    rows = [("s", i, "tool", "tool_output", f"header that every output has\n{i} {'abc' * i} own words {i * 7919}") for i in range(30)]
    rows += [("s", 30, "tool", "tool_output", rows[0][4] + " and more"), ("s", 31, "tool", "tool_output", "\n".join(f"line {k} of a long text" for k in range(40))), ("s", 32, "tool", "tool_output", "\n".join(f"line {k} of a long text" for k in range(1, 41)))]
    s = segment(spark.createDataFrame(rows, "session_id string, position int, role string, kind string, text string"))
    assert [(r.seg_id, r.base_id) for r in passes.envelope_dedup(s, passes.Context()).collect()] == [(32, 31)]


def test_streams_of_turns_know_what_came_before(spark, tmp_path):
    schema = "session_id string, position int, turn int, role string, kind string, tool_class string, path string, text string"
    source, shared = tmp_path / "in", tmp_path / "shared"
    store = engine.SessionStore(spark, str(shared))
    for n, rows in enumerate([[("s", 0, 0, "tool", "tool_output", "ls", None, "one"), ("s", 1, 1, "tool", "file_read", None, "a.rs", "v0")], [("s", 2, 2, "tool", "tool_output", "ls", None, "two"), ("s", 3, 3, "tool", "file_read", None, "a.rs", "v1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = segment(spark.readStream.schema(schema).parquet(str(source)))
        run = engine.plan_stream(stream, store, str(tmp_path / "ck"), passes=[passes.supersession]).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
        state = store.load(n + 1)
        assert [(r.tool_class, r.latest_turn) for r in state.registry.collect()] == [("ls", 2 * n)]
        assert [(r.path, r.text, r.version) for r in state.files.collect()] == [("a.rs", f"v{n}", n)]
    assert sorted(r.kept for r in store.reports().collect()) == [2, 2]


def test_board_keeps_what_the_task_needs(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    b = {r.name: r for r in leaderboard_of(board_items(spark, "/root/testdata/sf0.001")).collect()}
    # The published properties of the engine against truncation at this budget.
    assert b["engine"].fidelity >= 0.99 and b["engine"].divergence == 0 and b["engine"].ratio <= b["truncation"].ratio + 0.05
    assert b["none"].ratio == 1.0 and b["none"].fidelity == 1.0 and b["truncation"].fidelity == 0.0


def test_statistics_of_hard_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "y")], "g string, v string")
    assert {(r.g, r.value, r.n) for r in statistics.modal(rows.where("v is not null"), ["g"], F.col("v")).collect()} == {("a", "x", 1), ("b", "y", 1)}
    texts_ = spark.createDataFrame([(1, "a b c\nd e f\nx\na q c"), (2, ""), (3, None)], "k int, t string")
    widths = statistics.dominant_fields(texts_, "k", "t")
    assert [(r.k, r.width, r.n) for r in widths.collect()] == [(1, 3, 3)] and statistics.constant_fields(texts_, "k", "t", widths).count() == 0
    assert [r[0] for r in spark.createDataFrame([("a||b|",), ("",)], "t string").select(statistics.split_row(F.col("t"), "|")).collect()] == [["a", "", "b", ""], [""]]
