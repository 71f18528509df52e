import pytest
from pyspark.sql import functions as F

from segweave.functions import economics as E
from segweave.operators.memory import Memory
from segweave.streaming import monitors


def items(spark, rows):
    return spark.createDataFrame(rows, "content string, source string, ord long")


def test_memory(spark, tmp_path):
    m = Memory.empty(spark).remember(items(spark, [("jwt tokens expire", "a", 1), ("kafka lag", "a", 2), ("jwt tokens expire", "b", 3)]))
    assert [(r.id, r.content) for r in m.memories.orderBy("id").collect()] == [(1, "jwt tokens expire"), (2, "kafka lag")]
    m.write(str(tmp_path / "m"))
    m = Memory.read(spark, str(tmp_path / "m")).remember(items(spark, [("kafka lag", "c", 1), ("JWT and kafka", "c", 2)]))
    got = [(r.id, r.score, r.sources) for r in m.recall("JWT tokens", 5).collect()]
    assert got == [(1, 2, "a, b"), (3, 1, "c")]
    assert [r.id for r in m.recall("  ", 2).collect()] == [3, 2]
    assert tuple(m.stats().first()) == (3, 3)
    left = m.forget(spark.createDataFrame([(2,)], "id long"))
    assert left.memories.count() == 2 and left.provenance.where("memory_id = 2").count() == 0


def turns(spark, hits=None, outs=None):
    n = len(hits or outs)
    rows = [("s", i, (hits or [None] * n)[i], (outs or [0] * n)[i]) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, turn int, hit_rate double, output_tokens long")


@pytest.mark.parametrize(("hits", "want"), [([0.0, 0.1, 0.05, 0.99], [False, False, True, True]), ([0.0, 0.0, 0.9, 0.0, 0.0], [False] * 5), ([0.0, None, 0.0, 0.0], [False, False, False, True])])
def test_halts(spark, hits, want):
    assert [r.halted for r in monitors.halted_turns(turns(spark, hits), 0.217).orderBy("turn").collect()] == want


@pytest.mark.parametrize(("outs", "want"), [([100, 120, 110, 420], [0, 0, 0, 1]), ([100, 100, 400, 400, 400, 100], [0, 0, 1, 1, 1, 0])])
def test_spikes(spark, outs, want):
    assert [int(r.spiking) for r in monitors.spiking_turns(turns(spark, outs=outs)).orderBy("turn").collect()] == want


def test_sustained_level_is_released(spark):
    flags = [r.spiking for r in monitors.spiking_turns(turns(spark, outs=[100, 100] + [400] * 10)).orderBy("turn").collect()]
    assert 1 <= sum(flags) <= 5 and not flags[-1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k}", i, ((k * 7 + i * 3) % 10) / 10, 50 + (i * 97 + k * 31) % 400) for k in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "session_id string, turn int, hit_rate double, output_tokens long")
    source = str(tmp_path / "in")
    for lo in (0, 5):
        df.where((F.col("turn") >= lo) & (F.col("turn") < (5 if lo == 0 else 12))).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        out = monitors.monitor_stream(stream, 0.5)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.session_id, r.turn): (r.halted, r.spiking) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = monitors.halted_turns(df, 0.5).join(monitors.spiking_turns(df), ["session_id", "turn"])
    assert got == {(r.session_id, r.turn): (r.halted, r.spiking) for r in batch.collect()} and len(got) == 48


def test_controller_and_economics(spark):
    df = spark.createDataFrame([(False, 0.1), (True, 0.1), (False, 0.6), (False, 0.9), (True, 0.9)], "s boolean, f double")
    assert [r.c.label for r in df.select(E.controller(F.col("s"), F.col("f")).alias("c")).collect()] == ["default", "backoff", "tighten", "lossy", "tighten"]
    floors = {r.provider: r.f for r in E.cache_models(spark).select("provider", E.hit_rate_floor(F.col("write_mult"), F.col("read_mult")).alias("f")).collect()}
    assert floors["anthropic_5m"] == pytest.approx(0.21739, abs=1e-5) and floors["anthropic_1h"] == pytest.approx(0.52632, abs=1e-5) and floors["openai"] == 0
    one = spark.createDataFrame([(800, 400000, 200, 120000)], "a long, b long, c long, d long")
    r = one.select(*[c.alias(n) for n, c in E.output_reduction(*(F.col(x) for x in "abcd")).items()]).first()
    assert r.reduction_pct == pytest.approx(16.6667, abs=1e-3) and r.ci_lo_pct < r.reduction_pct < r.ci_hi_pct
