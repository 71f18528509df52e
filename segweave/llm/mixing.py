"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall by a hash of their id, source and text into the blocks of their source. A source's target buys whole passes
over its blocks and a prefix of one more; each pass takes the blocks in an order of its own, a keyed permutation. The last
pass ends within a block, there within a finer hash cell, and at last within one document, so that the words taken meet
the target. The counts of block draws by source stand at the root of a binary tree; each node splits its counts between two
halves by a multivariate hypergeometric draw, and the leaves are the output shards, which take disjoint runs of each
source's permuted draws and are shuffled by a random key of each draw. What is taken of a document is counted from the
rows so drawn and dealt.

Only DataFrame functions run here. Per source there are at most BLOCKS block sums, so the sums behind the cut stay small
at any size of the corpus; documents are joined only with one row of figures for each source, and text is moved once, to
its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Blocks of a source (a power of two), and cells of a block; shards is a power of two.
BLOCKS, CELLS, SHARDS, SEED = 4096, 4096, 16, 11
#: Partitions that a shard is dealt to at least, and words of each beyond that.
PARTS, PART_WORDS = 64, 16_000_000
#: Parts in which rows that are equal in everything are counted.
SALTS = 256
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _random(*columns: Column) -> Column:
    """A number in [0, 1) that the columns' values determine."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of sized(source, size): weights in turn by code point of the source, null last.

    With r = cap / weight ascending, the sources of the smallest r stop at their caps and the others share what is left by
    weight; the level is the first at which no further source is above its cap.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("asked", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weights", F.sum("weight").over(every))
    level = (F.col("asked") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    first = F.when(level * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), level.alias("level")))
    t = t.withColumn("first", first).withColumn("level", F.min("first").over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def _let(fields: dict[str, Column], use) -> Column:
    """use(struct of fields), each field evaluated once."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])), use), 1)


def _steps(a: Column, b: Column) -> Column:
    """a, a + 1, ... b; empty if b < a."""
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def _walk(xs: Column, ratio, goal: Column | None = None) -> Column:
    """Of probabilities that start from 1 and go on by ratio(x): their sum, or how many partial sums are below goal."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        more = lambda v: F.struct(v["p"].alias("p"), (v["sum"] + v["p"]).alias("sum"), (v["n"] + (v["sum"] + v["p"] < v["goal"]).cast("long")).alias("n"))
        return _let({"p": a["p"] * ratio(x), "sum": a["sum"], "n": a["n"], "goal": F.lit(0.0) if goal is None else goal}, more)

    return F.aggregate(xs, start, step)["sum" if goal is None else "n"]


def hypergeometric(n: Column, k: Column, want: Column, u: Column) -> Column:
    """How many of k marked among n are among want drawn, by inversion of u in [0, 1) from the mode outwards.

    Numbers beyond 16 deviations and 16 of the mode have probabilities below 1e-50 and are left out.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1.0)

    def bounds(v: Column) -> Column:
        n, k, want = v["n"], v["k"], v["want"]
        share = F.when(n > 0, k / n).otherwise(F.lit(0.0))
        return _let(
            {
                "n": n, "k": k, "want": want, "lo": F.greatest(zero, want - (n - k)), "hi": F.least(k, want),
                "middle": ((k + 1).cast("double") * (want + 1) / (n + 2)).cast("long"),
                "reach": (F.lit(16.0) * F.sqrt(F.greatest(want * share * (one - share), F.lit(0.0)))).cast("long") + 16,
            },
            lambda v: _let({"n": v["n"], "k": v["k"], "want": v["want"], "lo": v["lo"], "hi": v["hi"], "reach": v["reach"], "mode": F.least(F.greatest(v["middle"], v["lo"]), v["hi"])}, sums),
        )

    def sums(v: Column) -> Column:
        # p(x + 1) / p(x)
        up = lambda x: (v["k"] - x).cast("double") * (v["want"] - x) / ((x + 1).cast("double") * (v["n"] - v["k"] - v["want"] + x + 1))
        above = _steps(v["mode"], F.least(v["hi"], v["mode"] + v["reach"]) - 1)
        below = F.reverse(_steps(F.greatest(v["lo"], v["mode"] - v["reach"]), v["mode"] - 1))
        down = lambda x: 1 / up(x)
        return _let({"above": above, "below": below, "mode": v["mode"]}, lambda w: _let({"above": w["above"], "below": w["below"], "mode": w["mode"], "high": _walk(w["above"], up), "under": _walk(w["below"], down)}, lambda w: pick(w, up, down)))

    def pick(v: Column, up, down) -> Column:
        def chosen(w: Column) -> Column:
            goal_up, goal_down = w["u"] - 1, w["u"] - 1 - v["high"]
            higher = v["mode"] + F.least(_walk(v["above"], up, goal_up) + 1, F.size(v["above"]).cast("long"))
            lower = v["mode"] - F.least(_walk(v["below"], down, goal_down) + 1, F.size(v["below"]).cast("long"))
            return F.when(w["u"] < 1, v["mode"]).when(goal_down < 0, higher).otherwise(lower)

        return _let({"u": u * (v["high"] + v["under"] + 1)}, chosen)

    return _let({"n": n, "k": k, "want": want}, bounds)


def _left_share(quotas: Column, node: Column, level: int, seed: int) -> Column:
    """Quotas of a node's left half: a multivariate hypergeometric draw of half of the node's blocks.

    Sources are drawn in turn, each a hypergeometric number given what those before it took.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x)
    half = F.shiftright(total + F.pmod(F.xxhash64(node, F.lit(seed + level)), F.lit(2)), 1)
    start = F.struct(total.alias("left"), F.lit(0).cast("long").alias("i"), half.alias("want"), F.array().cast("array<bigint>").alias("took"))

    def take(s: Column, k: Column) -> Column:
        x = hypergeometric(s["left"], k, s["want"], _random(node, s["i"], F.lit(seed + level)))
        after = lambda v: F.struct((s["left"] - k).alias("left"), (s["i"] + 1).alias("i"), (s["want"] - v["x"]).alias("want"), F.concat(s["took"], F.array(v["x"])).alias("took"))
        return _let({"x": x}, after)

    return F.aggregate(quotas, start, take)["took"]


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """shard, quotas of quotas(quotas array<long>), one row: the leaves of the splitting tree."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("took", _left_share(F.col("quotas"), F.col("node"), level, seed))
        other = F.zip_with("quotas", "took", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("took").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), other.alias("quotas")))
        nodes = nodes.select(F.inline(halves))
    return nodes.select((F.col("node") - shards).alias("shard"), "quotas")


def _keys(text: Column, seed: int, blocks: int, cells: int) -> list[Column]:
    """print, place, cell and spot of a row: equal only for rows that are equal in id, source and text."""
    key = lambda n: F.xxhash64("doc_id", "source", F.xxhash64(text), F.lit(seed + n))
    return [F.xxhash64(text).alias("print"), F.pmod(key(0), F.lit(blocks)).alias("place"), F.pmod(key(1), F.lit(cells)).alias("cell"), key(2).alias("spot")]


def permuted(place: Column, source: Column, turn: Column, blocks: int, seed: int) -> Column:
    """The position of a block in a pass over its source: a permutation keyed by source, pass and seed.

    Multiplying by an odd number, adding, and folding high bits onto low ones all have inverses modulo a power of two.
    """
    if blocks & (blocks - 1):
        raise ValueError("blocks must be a power of two")
    mask, half = F.lit(blocks - 1).cast("long"), blocks.bit_length() // 2
    key = lambda i: F.xxhash64(source, turn, F.lit(seed + 100 + i)).bitwiseAND(mask)
    x = place.cast("long")
    for i in (0, 2):
        x = (x * key(i).bitwiseOR(F.lit(1).cast("long")) + key(i + 1)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftrightunsigned(x, half))
    return x


def plan_mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, blocks: int = BLOCKS, cells: int = CELLS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """sized(doc_id, source, print, size, place, cell, spot) of every row, and one row of figures for each source."""
    sized = scratch.write(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *_keys(F.col("text"), seed, blocks, cells)))
    same = lambda a, b: a.eqNullSafe(b)
    plan = source_targets(sized, weights, share, most).withColumn("goal", F.round("target").cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("long")))
    plan = scratch.write(plan.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")))
    of_source = plan.select(F.col("source").alias("s"), "passes")
    last = sized.join(of_source, same(F.col("source"), F.col("s"))).withColumn("position", permuted(F.col("place"), F.col("source"), F.col("passes"), blocks, seed)).drop("s", "passes")

    def cut(rows: DataFrame, by: str, rest: DataFrame, name: str) -> DataFrame:
        """Where the sum of size along by passes rest's rest: source, name (the by at which it does) and what is left then."""
        sums = rows.groupBy("source", by).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy(by)) - F.col("size")
        r = rest.select(F.col("source").alias("s"), "rest")
        at = sums.withColumn("upto", upto).join(r, same(F.col("source"), F.col("s"))).where("upto <= rest and rest < upto + size")
        return scratch.write(at.select("source", F.col(by).alias(name), (F.col("rest") - F.col("upto")).alias("rest")))

    def inside(rows: DataFrame, at: DataFrame, by: str, name: str) -> DataFrame:
        r = at.select(F.col("source").alias("s"), F.col(name).alias("v"))
        return rows.join(r, same(F.col("source"), F.col("s")) & (F.col(by) == F.col("v"))).drop("s", "v")

    block = cut(last, "position", plan, "cut_position")
    in_block = inside(last, block, "position", "cut_position")
    cell = cut(in_block, "cell", block, "cut_cell")
    spot = cut(inside(in_block, cell, "cell", "cut_cell"), "spot", cell, "cut_spot")
    for extra, drop in ((block, "rest"), (cell, "rest"), (spot, None)):
        e = extra.drop(drop) if drop else extra.withColumnRenamed("rest", "cut_words")
        e = e.withColumnRenamed("source", "s")
        plan = plan.join(e, same(F.col("source"), F.col("s")), "left").drop("s")
    # The block in which the last pass ends counts as a draw.
    draws = F.col("passes") * blocks + F.coalesce(F.col("cut_position") + 1, F.lit(0))
    plan = plan.withColumn("draws", draws.cast("long"))
    listed = plan.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "draws"))).alias("all"))
    leaves = shard_quotas(listed.select(F.transform("all", lambda x: x["draws"]).alias("quotas")), shards, seed)
    # ends[i]: the source's draws that shards 0 to i take.
    by_source = leaves.select("shard", F.posexplode("quotas").alias("rank", "n")).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("q"))
    ends = F.transform("q", lambda x, i: F.aggregate(F.slice("q", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]))
    named = listed.select(F.posexplode("all").alias("rank", "x")).select("rank", F.col("x.source").alias("s"))
    ends = named.join(by_source.select("rank", ends.alias("ends")), "rank").drop("rank")
    plan = plan.join(ends, same(F.col("source"), F.col("s")), "left").drop("s")
    return sized, scratch.write(plan.withColumnRenamed("source", "s"))


def placed(rows: DataFrame, plan: DataFrame, blocks: int, seed: int) -> DataFrame:
    """rows(source, size, place, cell, spot, ...) with their source's figures, before and at: where the cut leaves a row whole, or meets it."""
    d = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    d = d.withColumn("position", permuted(F.col("place"), F.col("source"), F.col("passes"), blocks, seed))
    ordered = lambda *names: F.struct(*[F.col(n) for n in names])
    before = ordered("position", "cell", "spot") < F.struct(F.col("cut_position").alias("position"), F.col("cut_cell").alias("cell"), F.col("cut_spot").alias("spot"))
    at = (F.col("position") == F.col("cut_position")) & (F.col("cell") == F.col("cut_cell")) & (F.col("spot") == F.col("cut_spot"))
    none = F.lit(False)
    return d.withColumn("before", F.coalesce(F.col("cut_position").isNotNull() & before, none)).withColumn("at", F.coalesce(at, none))


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with k: a number from 0 within their source, by counts of SALTS parts, so that no task holds them all."""
    kept = scratch.write(rows.withColumn("row_id", F.monotonically_increasing_id()).withColumn("salt", F.pmod("row_id", F.lit(SALTS))))
    counts = kept.groupBy("source", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("of"), F.col("salt").alias("of_salt"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = kept.withColumn("k", F.row_number().over(Window.partitionBy("source", "salt").orderBy("row_id")) - 1)
    joined = inside.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return joined.withColumn("k", F.col("k") + F.col("start")).drop("of", "of_salt", "salt", "start", "row_id")


def mix_sources(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of docs(doc_id, text, source).

    The mix is drawn, dealt to its shards and written; taken counts the words of the row's draws there, shards the shards
    that hold one. Null text has size 0; null is a source of its own, last in order. Rows without words take nothing. Rows
    that are equal in id, source and text share what is drawn of them evenly, to a word; all others, those of one id as
    well, are drawn by themselves. Each source's words meet its target rounded. The result depends on the rows alone, not
    on their order or partitions.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", "source")
    sized, plan = plan_mix(docs, scratch, blocks=blocks, shards=shards, seed=seed, **how)
    mixed = scratch.write(_drawn(docs.withColumn("print", F.xxhash64("text")), plan, scratch, blocks, shards, seed, how.get("cells", CELLS)), compression="zstd")
    # Rows that are equal in all of the key have equal draws, and each has one in turn 0.
    key = ["doc_id", "source", "print"]
    words = mixed.select(*key, "mix_shard", (F.col("mix_turn") == 0).cast("long").alias("row"), size_of(F.col("text")).alias("words"))
    by_key = words.groupBy(*key).agg(F.sum("words").alias("all_words"), F.expr("sum(words) div nullif(sum(row), 0)").alias("each"), F.size(F.collect_set("mix_shard")).alias("shards"))
    by_key = scratch.write(by_key.withColumnsRenamed({n: f"of_{n}" for n in key}))
    same = [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in key]
    t = placed(sized, plan, blocks, seed).select(*key, "size", "source_size", "target", "at").join(by_key, same[0] & same[1] & same[2], "left")
    zero = F.lit(0).cast("long")
    columns = ["doc_id", "size", "source_size", "target"]
    shards_of = F.coalesce("shards", F.lit(0)).alias("shards")
    whole = t.where("not at").select(*columns, F.coalesce("each", zero).alias("taken"), shards_of)
    # Equal rows at the cut share its words.
    met = numbered(t.where("at").select(*key, "size", "source_size", "target", "all_words", "shards"), scratch)
    many = met.groupBy("source").agg(F.count("*").alias("m")).select(F.col("source").alias("of"), "m")
    met = met.join(many, F.col("source").eqNullSafe(F.col("of")))
    part = F.expr("coalesce(all_words, 0) div m + int(k < coalesce(all_words, 0) % m)").cast("long")
    return whole.unionByName(met.select(*columns, part.alias("taken"), shards_of))


def mixed_rows(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """docs' columns, one row for each draw of a document with words, with shard and shuffle_key; each partition is sorted by both.

    A document that the cut meets gives the words that it is cut to, and its white space between them. Where docs has
    columns of these two names, those stay and the draw's get a further underscore.
    """
    scratch = Scratch(docs.sparkSession)
    _, plan = plan_mix(docs, scratch, blocks=blocks, shards=shards, seed=seed, **how)
    out = _drawn(docs, plan, scratch, blocks, shards, seed, how.get("cells", CELLS))

    def free(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    return out.select(*docs.columns, F.col("mix_shard").alias(free("shard")), F.col("mix_key").alias(free("shuffle_key")))


def _drawn(docs: DataFrame, plan: DataFrame, scratch: Scratch, blocks: int, shards: int, seed: int, cells: int) -> DataFrame:
    """docs' columns with mix_turn (the pass of the draw), mix_shard and mix_key of each draw."""
    names = docs.columns
    full = docs.select(F.struct(*names).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), *_keys(F.col("text"), seed, blocks, cells)).drop("print")
    t = placed(full, plan, blocks, seed).where("size > 0")
    kind = "array<struct<turn:bigint,words:bigint>>"
    passes = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: F.struct(p.alias("turn"), F.col("size").alias("words")))).otherwise(F.array().cast(kind))
    last = F.when(F.col("before"), F.array(F.struct(F.col("passes").alias("turn"), F.col("size").alias("words")))).otherwise(F.array().cast(kind))
    columns = ["row", "doc_id", "source", "size", "place", "ends"]
    draws = t.select(*columns, F.explode(F.concat(passes, last)).alias("d"))
    # Rows that the cut meets are few, or copies of one: in their turn they give their words until it is reached.
    met = numbered(t.where("at").select(*columns, "passes", "cut_words"), scratch)
    words = F.least(F.greatest(F.col("cut_words") - F.col("k") * F.col("size"), F.lit(0)), F.col("size")).cast("long")
    met = met.withColumn("d", F.struct(F.col("passes").alias("turn"), words.alias("words"))).where("d.words > 0")
    draws = draws.unionByName(met.select(*columns, "d"))
    at = F.col("d.turn") * blocks + permuted(F.col("place"), F.col("source"), F.col("d.turn"), blocks, seed)
    shard = F.element_at(F.transform(F.array(at), lambda x: F.size(F.filter("ends", lambda e: e <= x))), 1)
    text = F.col("row.text")
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("d.words").cast("int") + F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)), "")
    body = F.when(F.col("d.words") == F.col("size"), text).otherwise(cut)
    of = lambda n: F.col("row").getField(n)
    kept = [body.alias(n) if n == "text" else of(n).alias(n) for n in names]
    if "n_chars" in names:  # what is cut has fewer
        at_n = names.index("n_chars")
        kind_n = dict(docs.dtypes)["n_chars"]
        kept[at_n] = F.when((F.col("d.words") == F.col("size")) | of("n_chars").isNull(), of("n_chars")).otherwise(F.char_length(cut)).cast(kind_n).alias("n_chars")
    out = draws.select(*kept, F.col("d.turn").alias("mix_turn"), shard.alias("mix_shard"), F.xxhash64("doc_id", "source", "d.turn", "place", F.lit(seed + 3)).alias("mix_key"))
    # Each shard is a number of partitions that hold random documents of it, each in random order.
    total = plan.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    parts = max(PARTS, -(-total // (PART_WORDS * shards)))
    return out.repartition("mix_shard", F.pmod("mix_key", F.lit(parts))).sortWithinPartitions("mix_shard", "mix_key")
