"""Mixing, near duplicates, searches, packing and the pipeline on small fixtures, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from segweave.llm import ann, mixing, near_dup, packing, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def docs(spark, rows):
    """rows of (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOC)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# mixing


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    asked, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        left = asked - sum(most * sizes[s] for s in names if s not in free)
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]} if free else set()
        if not over:
            return {s: left * weight[s] / total if s in free else most * sizes[s] for s in names}
        free -= over


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 80)), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "empty"), (402, words(rng, 3000), "b"), (None, "no id here", "c"), (5, rows[5][1], rows[5][2])]
    return docs(spark, rows)


def test_targets_and_words_taken(sources):
    got = mixing.mix_sources(sources).collect()
    size = Counter()
    for r in sources.collect():
        size[r.source] += len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text or "") if w])
    want = brute_targets(dict(size))
    by = {(r.doc_id, r.taken, r.size): r for r in got}
    assert len(got) == sources.count() and all(r.taken <= 2 * r.size for r in got) and by
    near = sources.select("doc_id", "source", F.char_length("text").alias("n")).dropDuplicates(["doc_id", "source"])
    taken = mixing.mix_sources(sources).join(near, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for r in taken:
        assert r.target == pytest.approx(want[r.source])
        assert abs(r.taken - r.target) <= max(90, 0.02 * r.target), r


def test_reruns_agree_in_any_order(sources):
    a = {(r.doc_id, r.taken) for r in mixing.mix_sources(sources).collect()}
    assert a == {(r.doc_id, r.taken) for r in mixing.mix_sources(sources.repartition(7)).collect()}


def test_mixed_rows_are_what_is_taken(sources):
    rows = mixing.mixed_rows(sources)
    total = rows.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert total == mixing.mix_sources(sources).select(F.sum("taken")).first()[0]
    assert set(sources.columns) < set(rows.columns) and rows.select("shard").distinct().count() == mixing.SHARDS
    assert mixing.mixed_rows(docs(sources.sparkSession, [])).count() == 0 and mixing.mix_sources(docs(sources.sparkSession, [])).count() == 0


def test_taken_and_shards_are_those_of_the_draws(sources):
    once = sources.where("doc_id is not null and doc_id <> 5")
    words, shards = Counter(), defaultdict(set)
    for r in mixing.mixed_rows(once).collect():
        words[r.doc_id] += len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text) if w])
        shards[r.doc_id].add(r.shard)
    got = mixing.mix_sources(once).collect()
    assert len(got) == once.count() and {(r.doc_id, r.taken, r.shards) for r in got} == {(r.doc_id, words[r.doc_id], len(shards[r.doc_id])) for r in got}
    assert {r.shards for r in got} == {0, 1, 2}


def test_rows_that_repeat_an_id_take_what_is_theirs(spark):
    rng = random.Random(4)
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c d e f", "s"), (None, "x y", "s"), (None, "x y", None), (2, None, "s"), (3, words(rng, 9), None)]
    df = docs(spark, rows)
    got = mixing.mix_sources(df, most=3.0, share=2.0, weights=(1,)).collect()
    drawn = mixing.mixed_rows(df, most=3.0, share=2.0, weights=(1,)).select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert len(got) == 7 and sum(r.taken for r in got) == drawn and len({r.taken for r in got if (r.doc_id, r.size) == (1, 3)}) == 1


def test_each_source_meets_its_target_to_the_word(spark):
    rng = random.Random(9)
    # Two ids in three sources, rows that are equal in everything among them, and columns with the names of internal ones.
    rows = [(i % 2, words(rng, rng.randint(1, 9)) if i % 3 else "five words all the same", "abc"[i % 3 if i % 5 else 0]) for i in range(600)]
    df = docs(spark, rows)
    for c in ("place", "cell", "spot", "shard", "s", "k", "row", "at", "position"):
        df = df.withColumn(c, F.lit("own"))
    got = mixing.mix_sources(df)
    by = got.join(df.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size")), "source_size").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert got.count() == 600 and len(by) == 3
    assert all(r.taken == round(r.target) and r.over <= 0 for r in by), by
    drawn = mixing.mixed_rows(df)
    assert drawn.columns[: len(df.columns)] == df.columns and {"shard_", "shuffle_key"} <= set(drawn.columns)
    assert drawn.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r.taken for r in by)
    assert drawn.where("place = 'own' and shard = 'own'").count() == drawn.count()


def test_blocks_are_permuted_anew_in_each_pass(spark):
    p = spark.range(64).select("id", *[mixing.permuted(F.col("id"), F.lit("a"), F.lit(turn).cast("long"), 64, 1).alias(f"p{turn}") for turn in (0, 1)]).collect()
    assert sorted(r.p0 for r in p) == sorted(r.p1 for r in p) == list(range(64))
    assert [r.p0 for r in p] != [r.p1 for r in p] != list(range(64))


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = [4000, 2500, 100, 0, 7]
    leaves = [r.quotas for r in mixing.shard_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), 8).collect()]
    assert [sum(q[i] for q in leaves) for i in range(5)] == quotas and max(map(sum, leaves)) - min(map(sum, leaves)) <= 3
    long = lambda n: F.lit(n).cast("long")
    x = spark.range(6000).select(mixing.hypergeometric(long(100), long(30), long(50), F.rand(1)).alias("x"), mixing.hypergeometric(long(5), long(5), long(3), F.rand(2)).alias("y"))
    r = x.agg(F.avg("x"), F.variance("x"), F.min("y"), F.max("y")).first()
    assert abs(r[0] - 15) < 0.15 and abs(r[1] - 50 * 0.3 * 0.7 * 50 / 99) < 0.5 and r[2] == r[3] == 3


# near duplicates


def brute_classes(rows, threshold=0.8):
    import re

    sets = {}
    for i, t in rows:
        found = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else {(t or "").strip()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_parts_of_large_buckets_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for c in range(3):
        base = words(rng, 70).split()
        for k in range(25):
            # Copies of one base with a stretch of their own: some pairs are similar, some are not, and all share bands.
            own, at = rng.randint(0, 16), rng.randint(0, 50)
            rows.append((len(rows), " ".join(base[:at] + words(rng, own).split() + base[at + own :])))
    rows += [(len(rows) + k, rows[3 * k][1] + " " + words(rng, 12)) for k in range(20)]
    want = brute_classes(rows)
    assert 10 < len(set(want.values())) < 90
    for part in (2, 512):
        monkeypatch.setattr(near_dup, "PART", part)
        assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == want, part
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == want


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = words(rng, 120).split()
        for copy in range(rng.choice([1, 3, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = "changed" + str(copy)
            rows.append((len(rows), " ".join(text)))
    shared = words(rng, 60)
    rows += [(len(rows) + k, shared + " " + words(rng, 60)) for k in range(40)]
    rows += [(900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "..."), (905, "???")]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = near_dup.keep_one_of_each(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs(spark, []).columns


def test_hard_rows_of_near_duplicates(spark):
    rng = random.Random(9)
    text = words(rng, 50)
    df = docs(spark, [(1, text), (1, text), (2, text.upper()), (None, text), (3, words(rng, 40)), (3, words(rng, 44)), (4, words(rng, 3))])
    got = near_dup.near_duplicates(df.withColumn("id", F.lit(1)).withColumn("class_id", F.lit(2))).collect()
    assert len(got) == 7 and {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, None: None}
    assert sorted(r.doc_id or 0 for r in near_dup.keep_one_of_each(df).collect()) == [0, 1, 3, 3, 4]  # the rows of id 3 differ in text
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_pairs_whose_repeats_differ_are_found(spark):
    rng = random.Random(12)
    rows = []
    for more, times in [(30, 30), (45, 10), (20, 60)] * 10:
        base, passage = words(rng, 204), words(rng, more)
        rows += [(len(rows), base), (len(rows) + 1, " ".join([base, *[passage] * times]))]
    want = brute_classes(rows)
    assert all(want[i] == i - i % 2 for i in want)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == want


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = h[:300], h[100:]
    sig = near_dup.prob_min_hash(np.concatenate((a, b)), np.ones(600), np.repeat([0, 1], 300), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    w = np.concatenate((np.full(300, 3.0), np.ones(300)))
    scaled = near_dup.prob_min_hash(np.concatenate((a, a)), w, np.repeat([0, 1], 300), 2, 500)
    assert (scaled[0] == scaled[1]).mean() > 0.3  # weights scale, shares don't


# searches

VEC = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:500] = x[200]  # a very common vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(2000, None, 0), (2050, [], 0), (2100, [None] * 16, 0), (2150, [float("nan")] * 16, 0), (2200, [0.0] * 16, 0), (None, rows[0][1], 0), (7, rows[7][1], 0)]
    return spark.createDataFrame(rows + odd, VEC), x


def test_top_k_is_exact(vectors):
    df, x = vectors
    ints = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    data = {**dict(enumerate(ints)), 2200: np.zeros(16, np.int64)}
    got = defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    # The row that repeats an id is a candidate of its own.
    ids = np.array([*data, 7])
    m = np.array([*data.values(), data[7]])
    for q in [i for i in data if i % 50 == 0]:
        s = m @ data[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert got[q] == [(n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)], q
    assert set(got) == {i for i in data if i % 50 == 0}


def test_neighbours_recall_and_scores(vectors):
    df, x = vectors
    got = defaultdict(list)
    for r in ann.search_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = x.astype(np.float64)
    hits = []
    for q in range(0, 1500, 20):
        s = np.append(v @ v[q], v[7] @ v[q])
        s[q] = -9
        assert len(got[q]) == 20 and all(abs(s[i] - score) < 1e-12 for i, score in got[q]) and q not in dict(got[q])
        kth = np.sort(s)[-20]
        hits.append(np.mean([s[i] >= kth - 1e-12 for i, _ in got[q]]))
    assert np.mean(hits) >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_neighbours_among_thousands_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hot = rng.permutation(7000)[:3000]
    x[hot] = x[hot[0]]
    got = defaultdict(list)
    near = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    for r in ann.search_neighbours(near).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in [int(i) for i in hot if i % 20 == 0]:
        assert got[q] == [int(i) for i in np.sort(hot) if i != q][:20], q


def test_recall_where_codes_decide(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    v = x.astype(np.float64)
    recall = {}
    for share in (0.3, 0.85):
        got = defaultdict(set)
        # Lists hold some 375 rows, of which 40 are reranked: the codes choose them.
        for r in ann.search_neighbours(df, probe_share=share, rerank=40).collect():
            got[r.query_id].add(r.vec_id)
        assert all(len(g) == 20 for g in got.values()) and len(got) == 300
        hits = [len(got[q] & set(np.argsort(-np.where(np.arange(6000) == q, -9, v @ v[q]), kind="stable")[:20].tolist())) / 20 for q in range(0, 6000, 20)]
        recall[share] = np.mean(hits)
    assert recall[0.85] >= 0.9 and recall[0.3] >= 0.9, recall


def test_queries_that_the_bound_leaves_short_are_asked_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    asked = ann.search_units
    calls = []

    def cut(data, queries, *rest):
        calls.append(queries)
        # The first search loses rows, as codes might under the bound.
        return asked(data, queries, *rest).where("rank <= 3 or query_id % 40 = 0") if len(calls) == 1 else asked(data, queries, *rest)

    monkeypatch.setattr(ann, "search_units", cut)
    got = ann.search_neighbours(df).groupBy("query_id").count().collect()
    assert len(calls) == 2 and len(got) == 30 and {r["count"] for r in got} == {20}


def test_rows_that_repeat_an_id_are_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (0, [0.5, 0.0], 0), (1, [0.25, 0.0], 0)], VEC)
    rows = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert len(rows) == 9 and rows.count((0, 1, 0, 65536)) == 2 and rows.count((0, 3, 1, 8192)) == 1
    assert ann.search_neighbours(df).count() == 9


def test_small_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)], VEC)
    assert [tuple(r) for r in topk.top_k(few).orderBy("query_id", "rank").collect()] == [(0, 1, 3, 65536), (0, 2, 50, 0), (50, 1, 3, 65536), (50, 2, 0, 0)]
    assert ann.search_neighbours(few.withColumn("vec_id", F.col("vec_id") * 2)).count() == 4
    none = spark.createDataFrame([], VEC)
    assert topk.top_k(none).count() == 0 and ann.search_neighbours(none).count() == 0


# packing


def check_packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", "it's a <|endoftext|> ½² test_x", "Σας ΟΔΟΣ 日本語", words(rng, 4000), *(words(rng, rng.randint(1, 900)) for _ in range(150))]
    rows = packing.pack_documents(docs(spark, [*enumerate(texts), (None, "x"), (3, texts[3])]), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    used = check_packed(rows)
    total = sum(r.length for r in rows)
    assert used <= -(-total // packing.CAPACITY) + 2
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in enumerate(texts):
        if i == 3:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        parts = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048)) and sum(r.length for r in parts) == len(ids)
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts]
    assert len(pieces[3]) == 2 and len(pieces[None]) == 1
    assert packing.pack_documents(docs(spark, []), TOKENIZER).count() == 0


def test_pieces_of_every_character_below_250():
    ids_of = packing.WordPieceIds(TOKENIZER)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b {c}{c}7{c}'ll {c}.", f"{c}'{c}'S-{c}\u00b2{c}_"):
            assert ids_of(text) == ids_of.whole(text), text.encode()


def test_frequent_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 8)
    ids_of, asked = packing.WordPieceIds(TOKENIZER), Counter()
    model = ids_of.cache.model

    class Counted:
        def tokenize(self, word):
            asked[word] += 1
            return model.tokenize(word)

    ids_of.cache.model = Counted()
    for a in "abcdefgh":
        for b in "klmnopqr":
            text = f"the {a}{b}{a}, of"
            assert ids_of(text) == ids_of.whole(text)
    assert asked["the"] == asked["of"] == asked[","] == 1 and len(asked) == 67
    assert len(ids_of.cache) <= 8 and len(ids_of.cache.before) <= 8


def test_sequences_hold_the_ids(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 3000)) for _ in range(30)]
    rows = packing.pack_sequences(docs(spark, [*((i % 20, t) for i, t in enumerate(texts)), (None, None)]), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for t in [*texts, ""]:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.update(tuple(ids[at : at + packing.CAPACITY]) for at in range(0, len(ids), packing.CAPACITY))
    sequences = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == r.offset
        sequences[r.sequence_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert Counter(tuple(sequences[r.sequence_id][r.offset : r.offset + r.length]) for r in rows) == want
    assert max(map(len, sequences.values())) <= packing.CAPACITY


def test_exchange_between_partitions(spark):
    from segweave.llm.scratch import Scratch

    rng = np.random.default_rng(1)
    lengths = rng.integers(500, 1200, 3000)
    rows = spark.createDataFrame([(int(i), int(n), int(i) * 7919) for i, n in enumerate(lengths)], "doc_id long, length long, lot long")
    out = packing.pack_pieces(rows, Scratch(spark), group=400).collect()
    assert len(out) == 3000 and sorted(r.length for r in out) == sorted(lengths.tolist())
    used = check_packed(out)
    whole = packing.best_fit_decreasing(lengths)[2]
    assert packing.lower_bound(lengths) <= used <= len(whole) * 1.02 + 3


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(2)
    for low, high in ((1, 2048), (600, 1100), (1025, 2048), (1, 60), (2048, 2048)):
        lengths = rng.integers(low, high + 1, 300)
        sequence, offset, room = packing.best_fit_decreasing(lengths)
        assert packing.lower_bound(lengths) <= len(room)
        assert all(lengths[sequence == b].sum() == 2048 - r for b, r in enumerate(room))
    assert packing.lower_bound(np.full(10, 1100)) == 10


def test_certified_packings_are_optimal():
    rng = random.Random(3)

    def optimum(lengths, capacity):
        best = len(lengths)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for k, room in enumerate(rooms):
                if room >= lengths[i] and room not in rooms[:k]:
                    place(i + 1, rooms[:k] + [room - lengths[i]] + rooms[k + 1 :])
            place(i + 1, rooms + [capacity - lengths[i]])

        place(0, [])
        return best

    proven = 0
    for _ in range(300):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        rows = np.array(lengths)
        bound, found, least = packing.lower_bound(rows, 20), len(packing.best_fit_decreasing(rows, 20)[2]), optimum(lengths, 20)
        assert bound <= least <= found
        proven += bound == found
    assert proven > 250


# pipeline


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None), (None, "one two three four five six", "a"), (2, "", "a"), (2, "other words of the same id here", None), (3, "x" * 200_000, "b"), (4, "my mail is a.b@example.org and that is all", "b")]
    for name, found in (("odd", rows), ("empty", [])):
        df = docs(spark, found).withColumn("n_chars", F.char_length("text")).withColumn("shard", F.lit("own")).withColumn("piece", F.lit(7))
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, f"{tmp_path}/{name}")
            assert k == 4 or out.columns == df.columns
            out.write.parquet(f"{tmp_path}/{name}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            if name == "odd" and k == 3:
                assert all(r.n_chars == len(r.text) for r in now.collect()) and {r.shard for r in now.collect()} == {"own"}
        assert (now.count() > 0) == bool(found)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(5, 200)) + (" mail anna@x.org" if i % 9 == 0 else ""), f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(30)]
    rows += [(300 + i, words(rng, 20) + " idiot scum idiot moron", "s1") for i in range(60)]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 300)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == df.columns
    ids = {r.doc_id for r in seen["toxicity"]}
    assert len([i for i in ids if i >= 300]) <= 3 and len([i for i in ids if i < 300]) >= 147
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i in ids if not 200 <= i < 300 or i - 200 not in ids}
    assert not any("anna@x.org" in r.text for r in seen["pii"])
    assert Counter(r.doc_id for r in seen["mixing"]).most_common(1)[0][1] <= 2
    assert check_packed(seen["packing"]) >= 1 and len(seen["packing"]) >= len(seen["mixing"])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen["packing"])
