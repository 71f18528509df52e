import json

from pyspark.sql import functions as F

from segweave.functions import exprs as X
from segweave.plans import planner
from segweave.plans.segments import segment
from segweave.sources import requests

BODY = {
    "messages": [
        {"role": "user", "content": "please look at jwt"},
        {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "src/jwt.rs"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "fn verify"}, {"type": "text", "text": "note"}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t9", "content": [{"type": "text", "text": "one"}, {"type": "image", "text": None}, {"type": "text", "text": "two"}], "cache_control": {"type": "x"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "later"}]},
    ]
}


def test_anthropic_results(spark):
    df = spark.createDataFrame([("s", json.dumps(BODY))], "session_id string, body string")
    rows = requests.anthropic_tool_results(df).orderBy("position").collect()
    assert [(r.kind, r.tool_class, r.path, r.text, r.cached) for r in rows] == [
        ("file_read", "read", "src/jwt.rs", "fn verify", True),
        ("tool_output", "tool_result", None, "one", True),
        ("tool_output", "tool_result", None, "two", True),
        ("file_read", "read", "src/jwt.rs", "later", False),
    ]


def test_results_are_not_broadcast(spark):
    """A variant's width makes rows of many results look like none; none of their joins may trust that."""
    df = spark.createDataFrame([("s", json.dumps(BODY))], "session_id string, body string")
    plan = requests.anthropic_tool_results(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


def test_write_back(spark):
    rows = spark.createDataFrame([("s", 0, "tool", "tool_output", "t", None, "old " * 30), ("s", 1, "tool", "tool_output", "t", None, "new")], "session_id string, position int, role string, kind string, tool_class string, path string, text string")
    plan = planner.make_plan(segment(rows))
    out = [r.text for r in requests.written_back(rows, plan).orderBy("position").collect()]
    assert out == ["[tool output elided — superseded]", "new"]
    assert [r.text for r in requests.written_back(rows, plan, 1000).orderBy("position").collect()] == ["old " * 30, "new"]


def test_message_blocks_and_content(spark):
    m = spark.createDataFrame([("s", 0, "system", "be kind", None), ("s", 1, "tool", "out", "bash"), ("s", 2, "developer", "x", None)], "session_id string, position int, role string, text string, name string")
    assert [(r.role, r.kind, r.tool_class) for r in requests.message_blocks(m).orderBy("position").collect()] == [("system", "system_prompt", None), ("tool", "tool_output", "bash"), ("user", "conversation_turn", None)]
    c = spark.createDataFrame([('"plain"',), ('[{"type":"text","text":"a"},{"type":"image","url":"u"}]',)], "c string")
    assert [r.t for r in c.select(requests.content_text(F.col("c")).alias("t")).collect()] == ["plain", 'a\n{"type":"image","url":"u"}']


def test_files_and_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("two\nlines")
    (tmp_path / "b.txt").write_text("")
    assert [r.text for r in requests.files(spark, str(tmp_path)).collect()] == ["two\nlines"]
    line = json.dumps({"message": {"content": [{"type": "tool_result", "content": "out"}, {"type": "text", "text": "no"}]}})
    (tmp_path / "t.jsonl").write_text(f"{line}\nnot json\n")
    assert [r.text for r in requests.transcript_results(spark, str(tmp_path / "t.jsonl")).collect()] == ["out"]


def test_expressions(spark):
    df = spark.createDataFrame([(1, "see /Users/ann/x mail a@b.co Bearer abc", "v1.10.2"), (2, "", "1.9")], "id int, t string, v string").orderBy("id")
    assert df.select(X.redact(F.col("t"), 60).alias("r")).first().r == "see /Users/<user>/x mail <email> Bearer <tok>"
    assert df.select(X.token_count(F.col("t")).alias("n")).collect()[1].n == 0
    v = [r.p for r in df.select(X.version_parts(F.col("v")).alias("p")).collect()]
    assert v == [[1, 10, 2], [1, 9]] and v[0] > v[1]
    s = spark.createDataFrame([("One. Two! Three?\nEnd",)], "t string")
    assert s.select(X.sentences_of(F.col("t")).alias("s")).first().s == ["One.", "Two!", "Three?", "End"]
    u = spark.createDataFrame([(3700,), (65,), (5,)], "n int").select(X.uptime(F.col("n")).alias("u")).collect()
    assert [r.u for r in u] == ["1h 1m", "1m 5s", "5s"]
    k = spark.createDataFrame([('{"a":1}',), ("Error: no",), ("The answer is " + "long " * 60,), ("zzz " * 60,)], "t string")
    assert [r.c for r in k.select(X.output_category(F.col("t")).alias("c")).collect()] == ["json", "error_short", "prose", "other"]
