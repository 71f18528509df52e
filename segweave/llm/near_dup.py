"""MinHash near-dedup by ProbMinHash, banding and verification.

A text's distinct five-word shingles draw exponential arrival times (a Poisson process each, its rate the shingle's
weight); each arrival goes to a random register that keeps the shingle of the earliest, and an element stops as soon as
its next arrival is later than every register. Equal registers estimate probability Jaccard, which is the Jaccard of
the sets as all shingles of a text weigh the same, however often they repeat; bands of registers propose candidates and
exact shingle sets decide. Bands are the only step that can miss a pair: one at the threshold shares none of them seven
times in a hundred thousand.

Equal texts share a fingerprint and enter as one node, their smallest doc_id; buckets of the same nodes count once. Every
node is first compared with the hub of each of its buckets, the node whose buckets are fullest. In buckets that then still
hold several components, all nodes of different components are compared: those outside the bucket's largest component
with each other and with that one. Nodes meet in parts of bounded size and only links come out, so no pairs become rows;
what isn't compared lies in one component already, so no link between two components is lost. Of a bucket with m nodes
outside its largest component, a text goes to ceil(m / PART) tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, bound_batches, tidy

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
_WORD = re.compile(r"\w+")
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x100000001B3)
#: Nodes of a part and shingles of a part, about; columns of shingles handled at once.
PART, PART_SHINGLES, COLUMNS = 512, 1_000_000, 4096
#: Rows of a list of nodes that is broadcast to the texts at most, some 150 bytes each; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles, and texts, handled at once by the signature code.
_CHUNK, _CHUNK_TEXTS = 300_000, 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes by word, long words left out; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) > 100_000:
                self.clear()
            self[word] = h
        return h


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of words words, repeats kept. A shorter text is one shingle; one without words stands for itself."""
    found = words_of(text)
    if not found:
        return np.array([xxhash.xxh3_64_intdigest((text or "").strip(), seed=1)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(words, len(h))))
    for i in range(min(words, len(h))):
        out = _mix(out * _PRIME + h[i : i + n])
    return out


def prob_min_hash(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs, m) of elements h with weights, doc giving each element's row; a doc's elements are distinct."""
    first = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, np.uint64)
    scale = 1.0 / weight
    t = np.zeros(len(h))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(h):
            step += np.uint64(1)
            s = _mix(h + step * _GOLDEN)
            t = t - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale
            at = doc * m + (_mix(s ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
            won = t < first[at]
            at, tw, hw = at[won], t[won], h[won]
            np.minimum.at(first, at, tw)
            kept = tw == first[at]
            sig[at[kept]] = hw[kept]
            go = t < first.reshape(n_docs, m).max(axis=1)[doc]
            h, t, doc, scale = h[go], t[go], doc[go], scale[go]
    return sig.reshape(n_docs, m)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, fp1, fp2 (fingerprint of the words), n_shingles (distinct), band_keys (one long a band) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                begun, sets, prints, size = at, [], [], 0
                while at < len(ids) and size < _CHUNK and at - begun < _CHUNK_TEXTS:
                    h = shingle_hashes(texts[at].as_py(), hashes, words)
                    prints.append((xxhash.xxh3_64_intdigest(h.tobytes(), seed=2), xxhash.xxh3_64_intdigest(h.tobytes(), seed=3)))
                    u = np.unique(h)
                    sets.append(u)
                    size += len(u)
                    at += 1
                n = np.array([len(u) for u in sets])
                # Equal weights: registers then agree with the probability of the sets' Jaccard, which is what is verified.
                sig = prob_min_hash(np.concatenate(sets), np.ones(n.sum()), np.repeat(np.arange(len(n)), n), len(n), bands * rows)
                keys = np.full((len(n), bands), _GOLDEN) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = _mix(keys * _PRIME + sig.reshape(len(n), bands, rows)[:, :, r])
                fp = np.array(prints, np.uint64).view(np.int64).reshape(-1, 2)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(begun, at - begun), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(n, pa.int32()), lists], names=["id", "fp1", "fp2", "n_shingles", "band_keys"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(run), "id long, fp1 long, fp2 long, n_shingles int, band_keys array<long>")


_NO_LINKS = pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})


def _links(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    differ = a != b
    return pd.DataFrame({"u": np.maximum(a, b)[differ], "v": np.minimum(a, b)[differ]}).drop_duplicates()


def _hub_links(words: int, threshold: float):
    """Links (u, v), u > v, of a hub with the nodes of one of its parts."""
    hashes = _WordHashes()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hub = (rows["node"] == key[0]).to_numpy()
        mine = [np.unique(shingle_hashes(t, hashes, words)) for t in rows["t"][hub]]
        found = []
        for node, t in zip(rows["node"][~hub], rows["t"][~hub], strict=True):
            other = np.unique(shingle_hashes(t, hashes, words))
            for x in mine:
                both = np.searchsorted(x, other)
                common = int((x[np.minimum(both, len(x) - 1)] == other).sum())
                if common >= threshold * (len(x) + len(other) - common) - 1e-9:
                    found.append(node)
                    break
        found = np.array(found, np.int64)
        return _links(np.full(len(found), key[0], np.int64), found)

    return run


def _part_links(words: int, threshold: float):
    """Links (u, v), u > v, between different components of the nodes that meet; one for each two components."""
    hashes = _WordHashes()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        node, root, size = (rows[c].to_numpy() for c in ("node", "root", "n_shingles"))
        # Sets whose sizes differ too much can't be similar.
        open_pairs = (root[:, None] != root[None, :]) & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9)
        a, b = np.nonzero(np.triu(open_pairs, 1))
        if not len(a):
            return _NO_LINKS
        used = np.unique(np.concatenate((a, b)))
        sets = [np.unique(shingle_hashes(rows["t"].iat[i], hashes, words)) for i in used]
        held = np.repeat(np.arange(len(used)), [len(x) for x in sets])
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one text only can't be common.
        keep = counts[column] > 1
        held, column = held[keep], (np.cumsum(counts > 1) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        held, column = held[order], column[order]
        common = np.zeros((len(used), len(used)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            x = np.zeros((len(used), min(COLUMNS, width - at)), np.float32)
            x[held[lo:hi], column[lo:hi] - at] = 1
            common += x @ x.T
        a, b = np.searchsorted(used, a), np.searchsorted(used, b)
        sizes = np.array([len(x) for x in sets], np.float64)
        both = common[a, b].astype(np.float64)
        linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
        u, v = used[a[linked]], used[b[linked]]
        ends = pd.DataFrame({"x": np.minimum(root[u], root[v]), "y": np.maximum(root[u], root[v])})
        first = ~ends.duplicated().to_numpy()
        return _links(node[u[first]], node[v[first]])

    return run


def _parts(n: str, shingles: str):
    """Parts of n nodes with so many shingles in all."""
    return F.greatest(F.ceil(F.col(n) / PART), F.ceil(F.col(shingles) / PART_SHINGLES)).cast("int")


def _dealt(node, parts):
    return F.pmod(F.xxhash64(node, F.lit(17)), parts).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, class_id for every row of docs: texts chained by shingle Jaccard >= threshold share a class, named by its smallest id.

    Null text counts as empty; texts without words are alike if equal. Rows with a null id have a null class. Rows that
    repeat an id share that id's class, the smallest over its texts. No row is lost; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    sig = scratch.write(signatures(docs, id_col, text_col, words, bands, rows))
    known = sig.where("id is not null")
    repeated = not known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    of_print = known.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "n_shingles", "band_keys")).alias("m"))
    own = scratch.write(of_print.select("fp1", "fp2", F.col("m.id").alias("node"), "m.n_shingles", "m.band_keys"))
    member = scratch.write(known.select("id", "fp1", "fp2").join(own.select("fp1", "fp2", "node"), ["fp1", "fp2"]).select("id", "node"))
    no_id = scratch.write(sig.where("id is null").select("id"))
    keyed = own.select(F.explode("band_keys").alias("band"), "node", "n_shingles")
    full = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(keyed.join(full, "band"))
    scratch.drop(sig)
    # Of buckets that hold the same nodes one stays.
    alike = shared.groupBy("band", "n").agg(F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    once = alike.groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band")
    fullness = shared.groupBy("node").agg(F.sum("n").alias("fullness"))
    cand = scratch.write(shared.join(once, "band", "left_semi").join(fullness, "node"))
    scratch.drop(shared)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(text_col, F.lit("")).alias("t"))
    if repeated:
        texts = scratch.write(texts.join(cand.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "t"]))

    def with_texts(asked: DataFrame) -> DataFrame:
        """asked(node, ...) with t: a short list goes to the texts, a longer one meets them by a shuffle."""
        return texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "node")

    # The node whose buckets are fullest is nearest to what the bucket's others were copied from.
    best = cand.groupBy("band").agg(F.max(F.struct("fullness", (-F.col("node")).alias("less"), "n_shingles")).alias("m"))
    best = scratch.write(best.select("band", (-F.col("m.less")).alias("hub"), F.col("m.n_shingles").alias("hub_shingles")))
    fits = F.least("n_shingles", "hub_shingles") >= F.greatest("n_shingles", "hub_shingles") * threshold - 1e-9
    pairs = scratch.write(cand.join(best, "band").where((F.col("node") != F.col("hub")) & fits).select("hub", "node", "n_shingles").distinct())
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    hubs = scratch.write(hubs.select("hub", _parts("n", "shingles").alias("parts")))
    members = pairs.join(hubs, "hub").select("hub", _dealt(F.col("node"), F.col("parts")).alias("part"), "node")
    asked = scratch.write(members.union(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "hub")))
    links = scratch.write(with_texts(asked).groupBy("hub", "part").applyInPandas(tidy(_hub_links(words, threshold)), "u long, v long").distinct())
    for done in (best, pairs, hubs, asked):
        scratch.drop(done)
    roots = connected_components(links, scratch)
    # Buckets that still hold several components; two nodes alone have been compared.
    state = scratch.write(cand.where("n > 2").join(roots, "node", "left").select("band", "node", "n_shingles", F.coalesce("root", "node").alias("root")))
    by_root = state.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    summary = by_root.groupBy("band").agg(F.max(F.struct("n", (-F.col("root")).alias("less"), "shingles")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    summary = summary.where("n > main.n").select("band", (-F.col("main.less")).alias("main"), F.col("main.n").alias("n_main"), F.col("main.shingles").alias("s_main"), (F.col("n") - F.col("main.n")).alias("n_out"), (F.col("shingles") - F.col("main.shingles")).alias("s_out"))
    mixed = scratch.write(summary.select("band", "main", _parts("n_main", "s_main").alias("main_parts"), _parts("n_out", "s_out").alias("out_parts")))
    live = state.join(mixed, "band")
    out, inner = _dealt(F.col("node"), F.col("out_parts")), _dealt(F.col("node"), F.col("main_parts"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = lambda kind, one, two: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"))
    # A part of outsiders meets each part of the main component, itself in the first such meeting, and every other part of outsiders.
    main_meets = F.transform(upto("out_parts"), lambda k: meet("main", k, inner))
    others = F.transform(F.filter(upto("out_parts"), lambda k: k != out), lambda k: meet("out", F.least(out, k), F.greatest(out, k)))
    out_meets = F.concat(F.transform(upto("main_parts"), lambda k: meet("main", out, k)), others)
    sides = live.select("band", "node", "root", "n_shingles", F.explode(F.when(F.col("root") == F.col("main"), main_meets).otherwise(out_meets)).alias("m"))
    sides = scratch.write(sides.select("band", "m.kind", "m.one", "m.two", "node", "root", "n_shingles"))
    new = scratch.write(with_texts(sides).groupBy("band", "kind", "one", "two").applyInPandas(tidy(_part_links(words, threshold)), "u long, v long").distinct())
    more = new
    if repeated:
        # An id whose rows have different words ties the nodes of all of them together.
        more = more.union(member.where("id <> node").join(member.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "id").select(F.greatest("id", "node").alias("u"), F.least("id", "node").alias("v")))
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more).distinct(), scratch)
    for done in (cand, state, mixed, sides, links, own):
        scratch.drop(done)
    named = member.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("class_id"))
    if repeated:
        least = named.groupBy("id").agg(F.min("class_id").alias("class_id"))
        named = member.select("id").join(least, "id")
    kind = dict(docs.dtypes)[id_col]
    named = named.union(no_id.select("id", F.lit(None).cast("long")))
    return named.select(F.col("id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows of all but one document of each class; the smallest id stays.

    Rows that repeat an id and text are one document, of which one row stays; rows of a kept id with another text all stay.
    Rows with a null id have no class: of those with equal texts one stays.
    """
    classes = near_duplicates(docs, id_col, text_col, **how)
    classes = Scratch(docs.sparkSession).write(classes.where(F.col(id_col).isNotNull()))
    kept = classes.where(F.col(id_col) == F.col("class_id")).groupBy(id_col).agg(F.count("*").alias("rows_of_id"))
    kept = Scratch(docs.sparkSession).write(kept)
    once = lambda rows: rows.withColumn("print_of_text", F.xxhash64(text_col)).dropDuplicates([id_col, "print_of_text"]).drop("print_of_text")
    out = docs.join(kept.where("rows_of_id = 1").select(id_col), id_col, "left_semi")
    if not kept.where("rows_of_id > 1").isEmpty():
        out = out.unionByName(once(docs.join(kept.where("rows_of_id > 1").select(id_col), id_col, "left_semi")))
    lost = docs.where(F.col(id_col).isNull())
    return out.unionByName(once(lost)).select(docs.columns)
