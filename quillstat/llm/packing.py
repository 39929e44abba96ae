"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

``token_pieces`` tokenizes whole texts, ends each document with an end id and
cuts documents longer than a sequence.  ``best_fit_decreasing`` packs the
pieces: a segment tree over remaining capacities finds the tightest open bin in
logarithmic time.  Pieces of one length are interchangeable, and best fit sends
a run of them into the same bin until that bin is too small, so the plan works
on counts per length; it is the plan that the document-by-document rule gives.
Its size depends on the capacity, not on the corpus.  Spark then ranks the
pieces of each length and looks their place up in the plan.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows and null ids are packed like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together; larger groups are split.
RANKED_TOGETHER = 256
#: Most word forms a task keeps encoded.
CACHE_WORDS = 150_000
_SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Words(dict):
    """Little-endian ids of words that follow a space, encoded on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids


class Encoder:
    """Ids of the byte-level BPE as little-endian 32-bit numbers.

    No token reaches over a single space between two other characters, so a
    text is encoded word by word with a cache.  Words are encoded by the fast
    encoder over the same vocabulary; a text that holds a special token's
    string goes to the tokenizers library as a whole.
    """

    _edge = re.compile(r"(?<=\S) (?=\S)")
    _wide = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        self.json_path, self._whole = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = fast.encode_ordinary
        self.words = _Words(self.encode)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            if self._whole is None:
                from tokenizers import Tokenizer
                self._whole = Tokenizer.from_file(self.json_path)
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        words = self._edge.split(text) if self._wide.search(text) else text.split(" ")
        first = array("I", self.encode(words[0])).tobytes()
        return first + b"".join(map(self.words.__getitem__, words[1:]))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    head = n % capacity or capacity
    return [(0, min(n, head))] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                 json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    json_path = json_path or tokenizer_path()
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path)
        for b in batches:
            rows, out = [], []
            for k, text in enumerate(b.column("text")):
                ids = encode(text.as_py()) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(k)
                    out.append((i, start, length, zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32())]
                + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class SegmentTree:
    """Which remaining capacities have an open bin; finds the smallest one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, has: bool) -> None:
        i = room + self.leaves
        self.any[i] = has
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:  # up until a right neighbour holds something, then down its left edge
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


class Place(NamedTuple):
    """Pieces ``rank .. rank + n - 1`` of a length go ``per_bin`` at a time into bins from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    n: int
    per_bin: int
    bin: int
    offset: int


def best_fit_decreasing(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Place], int]:
    """The plan for ``counts`` pieces per length, and its number of bins."""
    tree, rooms, bins, plan = SegmentTree(capacity), defaultdict(list), 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (room // length))
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            per = room // length
            whole = min(n, left // per)
            if whole:
                plan.append(Place(length, rank, whole * per, per, first, capacity - room))
                put(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < n and left:
                plan.append(Place(length, rank, left, left, first + whole, capacity - room))
                put(room - left * length, first + whole, 1)
                put(room, first + whole + 1, n - whole - 1)
                left = 0
            else:
                put(room, first + whole, n - whole)
    return plan, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    plan, _ = best_fit_decreasing(counts, capacity)
    table = np.array(plan, dtype=np.int64).reshape(-1, 6)
    shift = max(counts.values(), default=0).bit_length()
    key = (table[:, 0] << shift) + table[:, 1]
    order = np.argsort(key)
    held = spark.sparkContext.broadcast((key[order], table[order]))
    split = spark.createDataFrame([(int(k), -(-n // RANKED_TOGETHER)) for k, n in counts.items()], "length long, parts long")
    p = (pieces.join(F.broadcast(split), "length")  # at most `capacity` rows
         .withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_b", F.pmod("_h", F.col("parts"))))
    before = (p.where("parts > 1").groupBy("length", "_b").agg(F.count(F.lit(1)).alias("in_b"))
              .withColumn("_before", F.sum("in_b").over(W.partitionBy("length").orderBy("_b")) - F.col("in_b")).drop("in_b"))
    p = (p.withColumn("_k", F.row_number().over(W.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece", "ids_crc32")))
         .join(before, ["length", "_b"], "left")
         .withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_k") - 1)
         .drop("parts", "_h", "_b", "_k", "_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, plan_ = held.value
        for b in batches:
            row = plan_[np.searchsorted(keys, (b["length"].to_numpy() << shift) + b["_rank"].to_numpy(), "right") - 1]
            nth = b["_rank"].to_numpy() - row[:, 1]
            yield b.drop(columns="_rank").assign(sequence_id=row[:, 4] + nth // row[:, 3],
                                                 offset=row[:, 5] + nth % row[:, 3] * row[:, 0])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(cols).schema)
    return p.select(*cols, "_rank").mapInPandas(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(token_pieces(docs, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
