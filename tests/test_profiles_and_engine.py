from segweave.operators import code_symbols, profiles
from segweave.plans import engine, planner
from segweave.plans.segments import segment


def test_samples_and_profile(spark, tmp_path):
    measured = profiles.measure(profiles.samples(spark))
    rows = {r["class"]: r for r in measured.collect()}
    assert set(rows) == {"json", "log", "code", "prose"} and all(r.lossy < r.original for r in rows.values() if r["class"] != "log")
    assert rows["json"].lossless < rows["json"].original and rows["prose"].lossless is None
    t = profiles.totals(measured).first()
    assert t.ratio >= t.ratio_strict > 1
    profile = profiles.learn(measured)
    profiles.save_profile(profile, str(tmp_path / "p"))
    loaded = profiles.load_profile(spark, str(tmp_path / "p"))
    assert loaded["lossy_code"] and (loaded["max_rows"], loaded["max_field"]) == (50, 120) and loaded["files"] == 4
    assert profiles.load_profile(spark, str(tmp_path / "none")) == profiles.DEFAULTS
    assert all(profiles.self_test().values())


def test_nothing_left_is_not_the_text_itself(spark):
    profiles.register(spark)
    words = spark.createDataFrame([("the " * 30,), ("short",), ("",), (None,)], "text string")
    words.createOrReplaceTempView("segweave_words")
    assert [r.t for r in spark.sql("SELECT telegraphic(text) AS t FROM segweave_words").collect()] == ["", "short", "", None]


def test_code_symbols():
    rust = 'fn verify_token(claims: &Claims) -> bool { // secret_comment\n let s = "secret_string"; claims.ok() }'
    assert code_symbols.identifiers(rust, "a.rs") == {"verify_token", "claims", "bool"}
    assert code_symbols.identifiers("def handle(request):\n    # note_here\n    return request.user\n", "a.py") == {"handle", "request", "user"}
    assert code_symbols.identifiers("plain words_here", "a.txt") == {"plain", "words_here"}
    assert code_symbols.identifiers("def broken(", "a.py") == {"def", "broken"}


def rows(spark, data):
    return segment(spark.createDataFrame(data, "session_id string, position int, role string, kind string, tool_class string, path string, text string"))


def test_state_of_earlier_turns(spark):
    first = rows(spark, [("s", 0, "tool", "tool_output", "git", None, "old"), ("s", 1, "tool", "file_read", None, "a", "v0")])
    plan, state = engine.plan_turn(engine.SessionState.empty(spark), first)
    assert planner.dropped(plan).count() == 0
    second = rows(spark, [("s", 5, "tool", "tool_output", "git", None, "newer"), ("s", 6, "tool", "file_read", None, "a", "v1")])
    _, state = engine.plan_turn(state, second)
    assert state.registry.first().latest_turn == 5
    f = state.files.first()
    assert (f.text, f.version) == ("v1", 1)
    late, _ = engine.plan_turn(state, first)
    assert [r.seg_id for r in planner.dropped(late).collect()] == [0]
    assert engine.latest_of(second, ["session_id"], "position").first().position == 6
