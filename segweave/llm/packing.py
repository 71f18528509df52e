"""Best-fit packing with certified bounds and repacking.

Texts become token ids; documents longer than a sequence are cut, and the pieces are packed by best-fit decreasing in
partitions of a bounded number of pieces. Dual feasible functions bound each partition's sequences from below: a
partition that meets its bound is proven optimal and settled. The others settle their full sequences and exchange the
documents of the rest: these meet in new partitions, dealt anew, and are packed again, for a few rounds.

Packing itself shuffles lengths and places only. The ids of all pieces are written once, each under its row number; a
sequence is its pieces' ids in order of their places, and who asks for figures alone reads them off the written ids.
The ids of a word are cached as bytes, so a text's ids are one join of bytes. Much of a corpus' vocabulary is met once: what
was met lately outlives it, and a worker's tasks share tokenizer and cache.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches, tidy

CAPACITY = 2048
#: Pieces that a partition packs at once, and times that open sequences are exchanged.
GROUP, ROUNDS = 60_000, 3
#: Distinct words whose ids a worker keeps in each of two generations, of at most LONGEST characters each.
CACHE, LONGEST = 150_000, 40


class WordPieceIds:
    """ids of a text as little-endian 32-bit bytes, as the tokenizer gives them without special tokens.

    The tokenizer splits normalised text into words and encodes each by itself. For texts of Latin letters its
    normaliser and split pattern are plain Python, and words' ids are cached; any other text goes to the tokenizer whole.
    """

    # The split pattern of the tokenizer's file over the characters below U+0250 in lower case. Letters (some
    # have their small form above U+0250) and numbers are spelled out and letters come first, which is found fastest.
    _LETTER, _NUMBER = "a-zªµºß-öø-ʯⱥⱦ", "0-9²³¹¼-¾"
    _PIECE = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
    _OTHER = re.compile(r"[\x1c-\x1fɐ-\U0010ffff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Cache(self.tokenizer)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        # A special token's string in the text is one the tokenizer takes as that token.
        if self._OTHER.search(text) or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.cache.__getitem__, self._PIECE.findall(text.lower())))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else one past U+00FF."""
    shows = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shows else chr(next(hidden)) for b in range(256)}


class _Cache(dict):
    """ids of words; a full generation is kept until the next one is full, and what is met of it passes on."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            shows = word.isascii() and word.isprintable()
            ids = [t.id for t in self.model.tokenize(word if shows else word.encode().decode("latin-1").translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.before = {}  # gives its memory back before the copy takes some
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out


@functools.lru_cache(1)
def _ids_of(path: str) -> WordPieceIds:
    """One for all tasks of a worker: the file takes a sixth of a second to read, and words met once are known to the next."""
    return WordPieceIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """row, doc_id, piece, start, ids, length, lot for each piece of docs(doc_id, text).

    ids are little-endian 32-bit numbers; row tells the pieces of one written table apart, lot is a random number to deal by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, step = _ids_of(tokenizer), capacity * 4
        task = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            row, piece, start, length, parts = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = ids_of(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    parts.append(part)
            lot = [zlib.crc32(struct.pack("<QQ", task, n + i)) for i in range(len(row))]
            at = pa.array(range((task << 40) + n, (task << 40) + n + len(row)), pa.int64())
            n += len(row)
            yield pa.RecordBatch.from_arrays(
                [at, batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(parts, pa.binary()), pa.array(length, pa.int64()), pa.array(lot, pa.int64())],
                names=["row", "doc_id", "piece", "start", "ids", "length", "lot"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"row long, doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, ids binary, length long, lot long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the dual-feasible-function bounds on the sequences that lengths (1 to capacity) need."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # f(x) = capacity above capacity - k, x from k to it, 0 below k
    mass, n = np.cumsum(count * x), np.cumsum(count)
    for k in range(1, capacity // 2 + 1):
        large = n[capacity] - n[capacity - k]
        best = max(best, int(large - (-(mass[capacity - k] - mass[k - 1]) // capacity)))
    # f(x) = x where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) capacity / k
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and the offset of each length, and the free room of each sequence."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_rooms >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        sequence[i], offset[i] = b, capacity - r
        room[b] = left = r - need
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return sequence, offset, np.array(room, np.int64)


def _packer(capacity: int, turn: int, last: bool):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        sequence, offset, room = best_fit_decreasing(lengths, capacity)
        proven = len(room) == lower_bound(lengths, capacity)
        rows = rows.drop(columns="deal")
        rows["sequence_id"] = ((turn << 26) + int(key[0]) << 32) + sequence
        rows["offset"] = offset
        rows["certified"] = proven
        rows["settled"] = last or proven or room[sequence] == 0
        return rows

    return pack


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """pieces(..., length, lot) with sequence_id, offset and certified (its partition met the bound)."""
    names = [c for c in pieces.columns if c != "lot"]
    left, packed = pieces, None
    for turn in range(rounds):
        n = left.count()
        groups = max(1, -(-n // group))
        last = turn == rounds - 1 or groups == 1
        dealt = left.withColumn("deal", F.pmod(F.xxhash64("lot", F.lit(turn)), F.lit(groups)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema) + ", sequence_id long, offset long, certified boolean, settled boolean"
        done = scratch.write(dealt.groupBy("deal").applyInPandas(tidy(_packer(capacity, turn, last)), schema))
        settled = done.where("settled").select(*names, "sequence_id", "offset", "certified")
        packed = settled if packed is None else packed.union(settled)
        if last:
            break
        left = done.where("not settled").select(*left.columns)
        if left.isEmpty():
            break
    return packed


def _packed(docs: DataFrame, tokenizer: str, capacity: int, group: int, rounds: int) -> DataFrame:
    """The written pieces with their places."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(token_pieces(docs, tokenizer, capacity), compression="zstd")
    places = pack_pieces(pieces.select("row", "length", "lot"), scratch, capacity, group, rounds).drop("length")
    length, crc = F.floor(F.octet_length("ids") / 4).alias("length"), F.crc32("ids").alias("ids_crc32")
    return pieces.select("row", "doc_id", "piece", "start", length, crc, "ids").join(places, "row")


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, ids for each piece of docs(doc_id, text).

    The ids (little-endian 32-bit numbers) of a sequence's pieces in order of offset are the sequence. Pieces and places are
    written tables, joined by number. Null text is empty: a piece of one token, the end mark 0. Null ids and repeated rows
    are documents like others, each packed by itself; an empty table gives no rows. certified tells whether the partition
    that settled a piece met its bound; after the last round those that didn't are settled as they are. tokenizer is the
    path of a tokenizer file that every executor has.
    """
    return _packed(docs, tokenizer, capacity, group, rounds).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "ids")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The figures of pack_sequences(), length and ids_crc32 taken of the written ids where they lie: ids aren't shuffled."""
    return pack_sequences(docs, tokenizer, capacity, group, rounds).drop("ids")
