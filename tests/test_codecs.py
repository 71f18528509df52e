import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from segweave.operators import codecs

VALUES = st.one_of(st.booleans(), st.integers(-(2**53), 2**53), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8), st.none())


def rows(n=20):
    return [{"id": i, "name": f"item {i}", "value": i * 1.5, "status": "ok"} for i in range(n)]


def test_top_level_table_is_encoded_and_decoded():
    text = json.dumps(rows())
    out = codecs.json_encode(text)
    assert out.startswith(codecs.JSON_TOP) and len(out) < len(text)
    assert codecs.json_decode(out) == rows() and out.count('"ok"') == 1


def test_nested_table_keeps_its_wrapper():
    value = {"status": "ok", "page": 1, "data": {"results": rows(), "count": 20}}
    out = codecs.json_encode(json.dumps(value))
    assert out.startswith(codecs.JSON_NESTED) and codecs.json_decode(out) == value


def test_row_of_another_shape_stays_whole():
    value = [*rows(5), {"id": 9, "fatal": True, "trace": "x"}, *rows(5)]
    out = codecs.json_encode(json.dumps(value))
    assert '"trace":"x"' in out and codecs.json_decode(out) == value


def test_what_is_no_table_is_refused():
    for text in ('{"a":1}', "[1,2,3]", '[{"a":1}]', "not json", "", "[NaN,1,2]"):
        assert codecs.json_encode(text) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), VALUES, min_size=1, max_size=5), min_size=3, max_size=8))
def test_json_round_trips(value):
    out = codecs.json_encode(json.dumps(value))
    assert out is None or codecs.dump_json(codecs.json_decode(out)) == codecs.dump_json(value)


def test_true_is_not_one():
    assert not codecs.json_round_trips("[true]", codecs.JSON_TOP + "[]\n{}")
    assert codecs.dump_json([True]) != codecs.dump_json([1]) and codecs.dump_json(1.0) != codecs.dump_json(1)


def test_log_template():
    log = "\n".join(f"2024-01-{i:02} INFO worker-{i} processed batch {i} ok" for i in range(1, 20))
    out = codecs.log_encode(log + "\nTraceback:  odd line\n" + log)
    assert out.startswith(codecs.LOG) and out.count("processed") == 1
    assert codecs.log_decode(out) == log + "\nTraceback:  odd line\n" + log


def test_log_refusals():
    for text in ("a b c\nd e f", "", "one\ntwo\nthree\nfour\nfive", "\n".join("a b c" for _ in range(9))):
        assert codecs.log_encode(text) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \r", max_size=8), max_size=12).map("\n".join))
def test_log_round_trips(text):
    out = codecs.log_encode(text)
    assert out is None or codecs.log_decode(out) == text


LINES = st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES, st.booleans(), st.booleans())
def test_deltas_apply_exactly(a, b, end_a, end_b):
    base, text = "\n".join(a) + "\n" * end_a, "\n".join(b) + "\n" * end_b
    assert codecs.delta_apply(base, codecs.delta_encode(base, text)) == text


def test_delta_is_small_and_checked():
    base = "\n".join(f"line {i}" for i in range(100))
    patch = codecs.delta_encode(base, base.replace("line 50", "changed"))
    assert patch.count("\n") <= 12 and "-line 50\n+changed\n" in patch
    assert not codecs.delta_round_trips(base.replace("line 49", "x"), base, patch)


def test_longest_common_subsequence():
    random.seed(3)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 10))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(codecs._shortest_edits(a, b)) == best[-1][-1]


def test_column_functions(spark):
    text = json.dumps(rows())
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id int, text string")
    out = df.withColumn("e", codecs.json_crush("text")).select("id", "e", codecs.expand("e").alias("x"), codecs.round_trips("text", "e").alias("ok")).orderBy("id").collect()
    assert [r.ok for r in out] == [True, None, None] and json.loads(out[0].x) == rows() and out[1].e is None
