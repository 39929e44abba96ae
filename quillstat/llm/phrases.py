"""Collocations of a corpus, counted in HAT-tries.

Each task counts its texts in one trie a language: below a shallow node of
first words hang hash containers of the words that follow, and a container that
grows past ``BURST`` entries bursts into one container per second word.  Words
are ids of the task's dictionary; a phrase that ends with its piece is padded,
so one entry of three words a position holds all its shorter phrases.  Once the
tries hold ``ENTRIES`` entries the largest subtrees leave the largest one whole,
as sorted runs, until half of it is left; a full dictionary empties them.  A run is cut by
prefix partition, the hash of a phrase's first two words, so that even the
most frequent first word is dealt to all partitions; the total of a first word
goes out with its subtree.  The runs of a prefix partition are merged by one
task, which knows every count of its two-word phrases by then, and only phrases
that reach the least count go on.  The number of partitions grows with the
text, so a task's merge does not.  Phrases meet phrases and words in shuffled
joins: written phrases are held in far fewer bytes than a broadcast of them
takes, and a salted table is sized as if it had one salt.

Scores are exact: products are decimals of 38 digits.

Defined results: a null or empty text has no words, a null language counts as
``und``; repeated rows count as often as they occur; words of any length count
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

#: Least count of a phrase, phrases listed a language, share of a phrase that a longer one must hold to replace it (percent).
LEAST, LISTED, HELD = 10, 2000, 50
#: Entries of a container that bursts, of a trie that spills, words of a dictionary, their bytes, and words between two updates.
BURST, ENTRIES, WORDS, WORD_BYTES, CHUNK = 4096, 1_000_000, 1 << 20, 1 << 26, 400_000
#: Bytes of a text that is split as a whole; longer ones are read word by word.
TEXT_BYTES = 1 << 20
#: Bytes of text behind one prefix partition.
PARTITION_BYTES = 12 << 20
#: Salts of a join on single words.
SALTS = 16
#: Entries of runs that a merge holds before it sums them up.
HELD_ENTRIES = 500_000

_BITS = 21
_MASK = (1 << _BITS) - 1
#: Ids behind the last word of a piece, of the total of a first word, and between two spaces.  None of their strings can be a word.
_END, _TOTAL, _GAP = 0, 1, 2
_RESERVED = (b"\n", b"\t", b"")
#: A-Z to a-z, piece ends to line feeds, tabs to spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class Trie:
    """First word -> container of packed phrases, or a node of second word -> container of packed phrases."""

    def __init__(self):
        self.roots: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}
        self.burst: set[int] = set()
        self.entries = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct packed phrases and their counts."""
        first = keys >> (2 * _BITS)
        at = np.flatnonzero(np.diff(first, prepend=-1))
        packed, n = keys.tolist(), counts.tolist()
        for w, a, z in zip(first[at].tolist(), at.tolist(), [*at[1:].tolist(), len(packed)]):
            box = self.roots.get(w)
            before = self.sizes.get(w, 0)
            if box is None:
                box = self.roots[w] = dict(zip(packed[a:z], n[a:z]))
                size = z - a
            elif w in self.burst:
                size = before
                for k, c in zip(packed[a:z], n[a:z]):
                    leaf = box.setdefault(k >> _BITS & _MASK, {})
                    size += k not in leaf
                    leaf[k] = leaf.get(k, 0) + c
            else:
                for k, c in zip(packed[a:z], n[a:z]):
                    box[k] = box.get(k, 0) + c
                size = len(box)
            if size > BURST and w not in self.burst:
                self._burst(w)
            self.sizes[w] = size
            self.entries += size - before

    def _burst(self, w: int) -> None:
        node: dict[int, dict] = {}
        for k, c in self.roots[w].items():
            node.setdefault(k >> _BITS & _MASK, {})[k] = c
        self.roots[w] = node
        self.burst.add(w)

    def largest(self, leave: int) -> list[int]:
        """First words of the largest subtrees, until ``leave`` entries are left."""
        out, left = [], self.entries
        for w in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if left <= leave:
                break
            out.append(w)
            left -= self.sizes[w]
        return out

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Packed phrases and counts of whole subtrees, which leave the trie; each has its total as an entry more."""
        sizes = np.array([self.sizes.pop(w) for w in words], np.int64)
        boxes = []
        for w in words:
            box = self.roots.pop(w)
            if w in self.burst:
                self.burst.discard(w)
                boxes.extend(box.values())
            else:
                boxes.append(box)
        n = int(sizes.sum())
        self.entries -= n
        keys = np.fromiter(chain.from_iterable(boxes), np.int64, n)
        counts = np.fromiter(chain.from_iterable(b.values() for b in boxes), np.int64, n)
        totals = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
        tops = np.array(words, np.int64) << 2 * _BITS | _TOTAL << _BITS
        return np.concatenate([keys, tops]), np.concatenate([counts, totals])


class Counter:
    """The tries of one task and its dictionary."""

    def __init__(self, parts: int):
        self.parts = parts
        self.pending: list[pa.RecordBatch] = []
        self._fresh()

    def _fresh(self) -> None:
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        for w in _RESERVED:
            self.ids[w]
        self.tries: dict[str, Trie] = defaultdict(Trie)
        self.buffers: dict[str, list[int]] = defaultdict(list)
        self.buffered = self.seen = self.word_bytes = 0

    def text(self, lang: str, text: bytes) -> None:
        self.word_bytes += len(text)  # never less than what its new words take
        if len(text) <= TEXT_BYTES:
            buffer = self.buffers[lang]
            before = len(buffer)
            buffer.extend(map(self.ids.__getitem__, text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")))
            buffer.append(_END)
            self.buffered += len(buffer) - before
            if self.buffered >= CHUNK:
                self.update()
            return
        for piece in text.translate(_TABLE).split(b"\n"):
            words = (m.group() for m in re.finditer(b"[^ ]+", piece))
            part = list(islice(words, CHUNK))
            while part:
                follow = list(islice(words, CHUNK))
                buffer, known = self.buffers[lang], self.ids.__getitem__
                buffer.extend(map(known, part))
                buffer.extend(~known(w) for w in follow[:2])  # seen by the words before, counted in the next round
                buffer.append(_END)
                self.buffered += len(part) + 3
                if self.buffered >= CHUNK:
                    self.update()
                part = follow

    def flush(self) -> None:
        """What is buffered goes into the tries."""
        for lang, buffer in self.buffers.items():
            a = np.array(buffer, np.int64)
            a = np.concatenate([a[a != _GAP], [_END, _END]])
            starts, a = a[:-2] > _END, np.where(a < 0, ~a, a)
            third = np.where(a[1:-1] == _END, _END, a[2:])
            packed = (a[:-2] << 2 * _BITS | a[1:-1] << _BITS | third)[starts]
            self.tries[lang].add(*np.unique(packed, return_counts=True))
        self.buffers.clear()
        self.buffered = 0

    def update(self) -> None:
        self.flush()
        if self.word_bytes > WORD_BYTES:
            self.word_bytes = sum(map(len, self.ids))
        if len(self.ids) > WORDS or self.word_bytes > WORD_BYTES:
            self.end()
            self._fresh()
        while sum(t.entries for t in self.tries.values()) > ENTRIES:
            lang = max(self.tries, key=lambda k: self.tries[k].entries)
            self.spill(lang, self.tries[lang].largest(self.tries[lang].entries // 2))

    def end(self) -> None:
        self.flush()
        for lang, trie in self.tries.items():
            self.spill(lang, list(trie.roots))

    def spill(self, lang: str, words: list[int]) -> None:
        if not words:
            return
        from xxhash import xxh64_intdigest
        keys, counts = self.tries[lang].take(words)
        spelled = list(self.ids)
        used = np.zeros(len(spelled), bool)
        for shift in (2 * _BITS, _BITS, 0):
            used[keys >> shift & _MASK] = True
        order = sorted(np.flatnonzero(used).tolist(), key=spelled.__getitem__)
        by_rank = [spelled[i] for i in order]
        rank, hashes = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.uint64)
        rank[order], hashes[order] = np.arange(len(order)), np.fromiter(map(xxh64_intdigest, by_rank), np.uint64, len(order))
        part = ((hashes[keys >> 2 * _BITS] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[keys >> _BITS & _MASK]) % np.uint64(self.parts)).astype(np.int64)
        keys = rank[keys >> 2 * _BITS] << 2 * _BITS | rank[keys >> _BITS & _MASK] << _BITS | rank[keys & _MASK]
        order = np.lexsort((keys, part))
        part, keys, counts = part[order], keys[order], counts[order]
        ranks = np.stack([keys >> 2 * _BITS, keys >> _BITS & _MASK, keys & _MASK])
        at = np.flatnonzero(np.diff(part, prepend=-1))
        runs = [_packed(by_rank, ranks[:, a:z], counts[a:z]) for a, z in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
        self.pending.append(pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(part[at], pa.int64()), pa.array(runs, pa.binary())], names=["lang", "part", "run"]))

    def runs(self) -> Iterator[pa.RecordBatch]:
        ready, self.pending = self.pending, []
        yield from ready


def _packed(words: list[bytes], ranks: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: its words, its phrases as places among them, its counts."""
    import zstandard
    used, at = np.unique(ranks, return_inverse=True)
    at = at.reshape(ranks.shape).astype("<u4")
    at[0, 1:] = np.diff(at[0])  # first words rise
    spelled = b" ".join([words[i] for i in used.tolist()])
    head = np.array([len(counts), len(spelled)], "<u8").tobytes()
    # bytes of one weight together: most are zero
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (*at, counts.astype("<u8"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes, spelled]))


def _unpacked(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    import zstandard
    b = zstandard.ZstdDecompressor().decompress(run)
    n, size = np.frombuffer(b, "<u8", 2).tolist()
    at, place = [], 16
    for kind, width in (("<u4", 4), ("<u4", 4), ("<u4", 4), ("<u8", 8)):
        plane = np.frombuffer(b, np.uint8, n * width, place).reshape(width, n).T
        at.append(np.ascontiguousarray(plane).view(kind).reshape(n).astype(np.int64))
        place += n * width
    at[0] = np.cumsum(at[0])
    return b[place:place + size].split(b" "), np.stack(at[:3]), at[3]


class Merge:
    """Sums over the runs of one prefix partition: phrases as (first, second) and third word ids, and their counts."""

    def __init__(self):
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, run: bytes) -> None:
        words, at, n = _unpacked(run)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.parts.append((ids[at[0]] << 32 | ids[at[1]], ids[at[2]].astype(np.int32), n))
        self.held += len(n)
        if self.held > HELD_ENTRIES + 2 * len(self.parts[0][2]):  # sums are redone at every doubling only
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            pair, third, n = (np.concatenate(x) for x in zip(*self.parts))
            self.parts.clear()
            order = np.lexsort((third, pair))
            pair, third, n = pair[order], third[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            self.parts.append((pair[cut], third[cut], np.add.reduceat(n, cut)))
        self.held = len(self.parts[0][2])
        return self.parts[0]


def _merged(least: int):
    def merge(key, runs):
        """All runs of a prefix partition -> its phrases that reach the least count, and the words it holds totals of."""
        m = Merge()
        for run in runs.column("run"):
            m.add(run.as_py())
        pair, third, n = m.sum()
        end, total = m.ids[_RESERVED[_END]], m.ids[_RESERVED[_TOTAL]]
        words = np.array([*m.ids, None], object)[:-1]
        order = np.argsort(pair, kind="stable")  # sorted already unless there was one run
        pair, third, n = pair[order], third[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        two, n2 = pair[cut], np.add.reduceat(n, cut)
        single = two & 0xFFFFFFFF == total
        one = single & (n2 >= least)
        both = ~single & (two & 0xFFFFFFFF != end) & (n2 >= least)
        all_ = (pair & 0xFFFFFFFF != total) & (third != end) & (n >= least)
        none = np.full(int(one.sum()) + int(both.sum()), None, object)
        w1 = np.concatenate([words[two[one] >> 32], words[two[both] >> 32], words[pair[all_] >> 32], [None]])
        w2 = np.concatenate([none[:int(one.sum())], words[two[both] & 0xFFFFFFFF], words[pair[all_] & 0xFFFFFFFF], [None]])
        w3 = np.concatenate([none, words[third[all_]], [None]])
        f = np.concatenate([n2[one], n2[both], n[all_], [n2[single].sum()]])
        return pa.table({"lang": pa.array([key[0].as_py()] * len(f), pa.string()), **{k: pa.array(v.tolist(), pa.binary()) for k, v in (("w1", w1), ("w2", w2), ("w3", w3))},
                         "f": pa.array(f, pa.int64())})
    return merge


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, w1, w2, w3, f``: written counts of the phrases of 1 to 3 words that occur ``least`` times; rows without words hold shares of a language's words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // PARTITION_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(parts)
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                counter.text(lang.as_py(), text.as_py())
                yield from counter.runs()
        counter.end()
        yield from counter.runs()

    runs = texts.mapInArrow(count, "lang string, part long, run binary")
    found = runs.groupBy("lang", "part").applyInArrow(_merged(least), "lang string, w1 binary, w2 binary, w3 binary, f long")
    return written(found.select("lang", *(F.col(w).cast("string").alias(w) for w in ("w1", "w2", "w3")), "f"), "phrases")


def _with_count(t: DataFrame, words: DataFrame, on: str, name: str) -> DataFrame:
    """Counts of single words beside phrases; a frequent word's phrases are dealt to ``SALTS`` keys."""
    salted = words.select(F.col("lang"), F.col("w1").alias(on), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return (t.withColumn("_salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)).cast("int"))
            .join(salted.hint("merge"), ["lang", on, "_salt"]).drop("_salt"))


def _score(a: str, left: str, right: str):
    d = lambda c: F.col(c).cast("decimal(19,0)")
    t = F.lit(1_000_000).cast("decimal(38,0)") * d(a) * d(a)
    return F.call_function("div", t, (d(left) * d(right)).cast("decimal(38,0)"))


def collocations(counts: DataFrame, held: int = HELD, listed: int = LISTED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` from the rows of ``phrase_counts``."""
    n = counts.where("w1 is null").groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    one = counts.where("w1 is not null and w2 is null")
    two = counts.where("w2 is not null and w3 is null")
    three = counts.where("w3 is not null")
    longer = (three.select("lang", "w1", "w2", "f").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
              .groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer")))
    pairs = two.join(longer.hint("merge"), ["lang", "w1", "w2"], "left").where(
        F.coalesce(100 * F.col("longer").cast("decimal(38,0)") < held * F.col("f").cast("decimal(38,0)"), F.lit(True))).withColumnRenamed("f", "a")
    pairs = _with_count(_with_count(pairs, one, "w1", "l"), one, "w2", "r").withColumn("score", _score("a", "l", "r"))
    head = two.withColumnRenamed("f", "head")
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("tail"))
    triples = (three.withColumnRenamed("f", "a").join(head.drop("w3").hint("merge"), ["lang", "w1", "w2"]).join(tail.hint("merge"), ["lang", "w2", "w3"]))
    triples = _with_count(_with_count(triples, one, "w1", "first"), one, "w3", "last")
    cuts = F.array_sort(F.array(F.struct(_score("a", "first", "tail").alias("score"), F.lit(1).alias("k"), F.col("first").alias("l"), F.col("tail").alias("r")),
                                F.struct(_score("a", "head", "last").alias("score"), F.lit(2).alias("k"), F.col("head").alias("l"), F.col("last").alias("r"))))
    triples = triples.withColumn("cut", F.get(cuts, F.lit(0))).select("lang", "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    columns = ["lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score"]
    every = pairs.select(*columns).unionByName(triples.select(*columns))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= listed)
    return best.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(documents(spark, sf_dir)))


#: The same by plain counting, for DuckDB.
ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g1 AS (SELECT lang, unnest(ws) AS a FROM w),
g2 AS (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: {'a': ws[i], 'b': ws[i + 1]})) AS g FROM w),
g3 AS (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]})) AS g FROM w),
f1 AS (SELECT lang, a, count(*) AS f FROM g1 GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, g.a AS a, g.b AS b, count(*) AS f FROM g2 GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g.a AS a, g.b AS b, g.c AS c, count(*) AS f FROM g3 GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) x GROUP BY ALL),
two AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * f2.f * f2.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  LEFT JOIN longer o ON o.lang = f2.lang AND o.a = f2.a AND o.b = f2.b
  WHERE o.f IS NULL OR 100 * o.f < 50 * f2.f),
cuts AS (
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
three AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored) x WHERE cut = 1),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank
  FROM (SELECT * FROM two UNION ALL SELECT * FROM three) x)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
