import pytest
from pyspark.sql import functions as F

from segweave.plans import passes, planner
from segweave.plans.passes import Context
from segweave.plans.segments import segment
from segweave.sources import requests


def segs(spark, rows):
    """rows of (kind, tool_class, path, text) in one session, or with a session before them."""
    full = [("s", i, "tool", *r) for i, r in enumerate(rows)]
    return segment(spark.createDataFrame(full, "session_id string, position int, role string, kind string, tool_class string, path string, text string"))


def ids(df):
    return sorted(r.seg_id for r in df.select("seg_id").collect())


def test_supersession(spark):
    s = segs(spark, [("tool_output", "cargo", None, "a"), ("tool_output", "cargo", None, "b"), ("tool_output", "git", None, "c"), ("file_read", None, "x", "d"), ("tool_output", "cargo", None, "e")])
    assert ids(passes.supersession(s, Context())) == [0, 1]
    registry = spark.createDataFrame([("s", "git", 9)], "session_id string, tool_class string, latest_turn int")
    assert ids(passes.supersession(s, Context(registry=registry))) == [0, 1, 2]
    old = spark.createDataFrame([("s", "git", 1)], "session_id string, tool_class string, latest_turn int")
    assert ids(passes.supersession(s, Context(registry=old))) == [0, 1]


def test_exact_dedup_is_across_kinds_and_spares_turns(spark):
    s = segs(spark, [("file_read", None, "a", "same"), ("tool_output", "t", None, "same"), ("conversation_turn", None, None, "same"), ("file_read", None, "b", "same")])
    assert ids(passes.exact_dedup(s, Context())) == [1, 3]


def test_file_delta_against_the_first_read(spark):
    base = "\n".join(f"line number {i} of the file" for i in range(40))
    s = segs(spark, [("file_read", None, "a", base), ("file_read", None, "a", base.replace("number 7", "seven")), ("file_read", None, "b", "other"), ("file_read", None, "a", base)])
    plan = {r.seg_id: r for r in planner.make_plan(s, passes=[passes.file_delta]).collect()}
    assert plan[1].action == "replace" and plan[1].base_id == 0 and plan[1].new_tokens < plan[1].token_count
    assert [plan[i].action for i in (0, 2, 3)] == ["keep"] * 3


def test_envelope(spark):
    text = "\n".join(f'{{"id": {i}, "value": "some longer value {i}"}}' for i in range(30))
    s = segs(spark, [("tool_output", "a", None, text), ("tool_output", "b", None, text.replace("value 3", "other 3")), ("tool_output", "c", None, "nothing alike\n" * 20)])
    got = passes.envelope_dedup(s, Context()).collect()
    assert [(r.seg_id, r.base_id) for r in got] == [(1, 0)]


def test_reasoning(spark):
    s = segs(spark, [("reasoning_trace", None, None, "let me see"), ("reasoning_trace", None, None, "Therefore it is so"), *[("conversation_turn", None, None, "x")] * 7, ("reasoning_trace", None, None, "hm")])
    assert ids(passes.reasoning_prune(s, Context())) == [0]


def test_relevance_is_transitive(spark):
    rows = [("file_read", None, "a", "jwt_token verify_claims"), ("file_read", None, "b", "verify_claims helper_fn"), ("file_read", None, "c", "kubernetes pods"), *[("conversation_turn", None, None, "zzz")] * 7]
    s = segs(spark, rows)
    assert ids(passes.relevance(s, Context("check jwt_token"))) == [2]
    assert ids(passes.relevance(s, Context(""))) == []


def test_later_passes_win_and_rejected_ones_keep(spark):
    s = segs(spark, [("tool_output", "t", None, "x" * 40), ("tool_output", "t", None, "y" * 40)])
    drop = passes._proposal(s.where("seg_id = 0"), "drop", "superseded")
    bad = passes._proposal(s.where("seg_id = 0"), "replace", "duplicate", F.lit("no delta"), "json_columnar")
    assert planner.resolve(s, [bad, drop]).where("seg_id = 0").first().action == "drop"
    assert planner.enforce(s, planner.resolve(s, [drop, bad])).where("seg_id = 0").first().action == "keep"


def test_frozen_stays_and_delta_needs_its_base(spark):
    base = "\n".join(f"line {i} with some words" for i in range(30))
    s = segs(spark, [("system_prompt", None, None, "be kind " * 10), ("file_read", None, "a", base), ("file_read", None, "a", base + "\nmore")])
    frozen = passes._proposal(s.where("seg_id = 0"), "drop", "evicted")
    gone = passes._proposal(s.where("seg_id = 1"), "drop", "duplicate")
    plan = planner.enforce(s, planner.resolve(s, [passes.file_delta(s, Context()), gone, frozen]))
    assert {r.seg_id: r.action for r in plan.collect()} == {0: "keep", 1: "drop", 2: "keep"}


def test_eviction(spark):
    s = segs(spark, [("system_prompt", None, None, "s" * 400), ("file_read", None, "a", "alpha_token " + "a" * 388), ("file_read", None, "b", "b" * 400), ("file_read", None, "c", "c" * 400)])
    plan = planner.evict(s, planner.resolve(s, []), "alpha_token", 250)
    assert ids(planner.dropped(plan)) == [2, 3]
    floored = planner.report(planner.evict(s, planner.resolve(s, []), "alpha_token", 10, floor=0.5)).first()
    assert floored.net_tokens >= 200


def test_coreference_counts_other_segments(spark):
    s = segs(spark, [("file_read", None, "a", "shared_one x1"), ("file_read", None, "b", "shared_one shared_two"), ("file_read", None, "c", "shared_two"), ("file_read", None, "d", "alone_here")])
    got = {r.seg_id: r.frequency for r in planner.coreference(passes.segment_symbols(s)).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 0}


def test_emit_orders_by_stability_and_reports(spark):
    s = segs(spark, [("conversation_turn", None, None, "fast one"), ("system_prompt", None, None, "frozen"), ("conversation_turn", None, None, "fast two"), ("compact_summary", None, None, "slow")])
    plan = planner.resolve(s, [passes._proposal(s.where("seg_id = 2"), "drop", "evicted")])
    assert [r.seg_id for r in planner.emit(s, plan).orderBy("ordinal").collect()] == [1, 3, 0]
    assert planner.joined_context(planner.emit(s, plan)).first().context == "frozen\n---\nslow\n---\nfast one"
    r = planner.report(plan).first()
    assert (r.kept, r.dropped, r.replaced) == (3, 1, 0) and r.net_tokens < r.input_tokens


def test_pipeline_end_to_end(spark):
    s = segs(spark, [("system_prompt", None, None, "You are careful."), ("tool_output", "cargo-test", None, "old run failed"), ("tool_output", "cargo-test", None, "new run passed"), ("file_read", None, "src/jwt.rs", "fn verify(jwt) authentication")])
    emitted, report = planner.compress(s, "authentication jwt middleware")
    texts = [r.text for r in emitted.orderBy("ordinal").collect()]
    assert texts[0] == "You are careful." and "old run failed" not in texts and any("authentication" in t for t in texts)
    assert report.first().dropped >= 1
    strict, _ = planner.compress(s, "authentication", budget=10, strict=True)
    assert strict.count() >= 1


def test_bad_kind_is_an_error(spark):
    ok = '[{"role":"user","kind":"conversation_turn","text":"hi"},{"role":"tool","kind":"tool_output","text":"x"}]'
    rows = segment(requests.context_blocks(spark.createDataFrame([("s", ok)], "session_id string, value string"))).orderBy("position").collect()
    assert [r.tool_class for r in rows] == [None, "unknown"]
    for bad in ('[{"role":"user","kind":"nonsense","text":"hi"}]', '[{"role":"king","kind":"diff","text":"hi"}]', "no json"):
        with pytest.raises(Exception):
            requests.context_blocks(spark.createDataFrame([("s", bad)], "session_id string, value string")).collect()
