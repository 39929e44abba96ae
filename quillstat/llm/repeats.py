"""Exact removal of byte strings that occur more than once, over whole corpora.

``remove_repeats`` removes every byte covered by a string of ``least`` bytes
that also starts anywhere else, in the same text or another.

Each window of ``least`` bytes belongs to one content-defined anchor
(:mod:`.anchors`), so equal windows meet under the same anchor hash, and a run
of windows under one anchor is one row.  Anchors that occur once are done.  If
all runs of a repeated anchor are equal, their windows are repeats.  Otherwise
the distinct runs are brought together and the suffix array of their segments
gives the maximal repeats among them (:mod:`.suffix`).  An anchor with more than
``TOGETHER`` rows is never brought together: its distinct runs are cut into
cells of ``CELL`` windows at fixed places beside the anchor, and Spark counts
128-bit hashes.  A cell whose bytes common to all its windows occur once is
done, one whose whole bytes occur again is a repeat, and only the others are
compared window by window.  Equal runs are met by two 64-bit hashes (anchor and
run).

Defined results: a null or empty text has no bytes and keeps the empty string;
texts shorter than ``least`` bytes lose nothing; repeated rows are repeats of
each other; null ids are rows like any other; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import anchors, suffix
from .common import documents, partitions, written

LEAST = 200
#: Rows of an anchor up to which its distinct runs are compared in one task.
TOGETHER = 2000
#: Windows of a cell.
CELL = 8
#: Segment bytes that a suffix array is built over at a time (whole anchors), and runs a task remembers as sent.
SORTED_BYTES, REMEMBERED = 2 << 20, 1_000_000
UNIFORM, MIXED, HOT = 0, 1, 2

_RANGES = "array<struct<a:long,b:long>>"
_CELLS = "array<struct<o:long,core:binary,whole:binary,windows:array<binary>>>"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _source(docs: DataFrame, *keep: str) -> DataFrame:
    """``_k, _t, _bytes`` and the columns ``keep``: rows keyed by id and text hash; a null id is keyed by the text."""
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.xxhash64("doc_id")
    return docs.select(*keep, F.coalesce(number, F.xxhash64(text)).alias("_k"), F.xxhash64(text).alias("_t"), text.cast("binary").alias("_bytes"))


def anchor_rows(src: DataFrame, least: int, run_hash: bool) -> DataFrame:
    """``h, run`` of every run, or the distinct ``h, _k``."""
    name = "run" if run_hash else "_k"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _bytes_of(b.column("_bytes"))
            keys = b.column("_k").to_numpy()
            for r in anchors.runs(data, offsets, least):
                if run_hash:
                    yield pa.RecordBatch.from_arrays([_signed(r.h), _signed(r.run)], names=["h", name])
                else:
                    _, one = np.unique(r.h ^ anchors.mixed(r.text.astype(np.uint64)), return_index=True)
                    yield pa.RecordBatch.from_arrays([_signed(r.h[one]), pa.array(keys[r.text[one]], pa.int64())], names=["h", name])

    return src.select("_k", "_bytes").mapInArrow(rows, f"h long, {name} long")


def repeated_anchors(src: DataFrame, least: int, together: int = TOGETHER) -> DataFrame:
    """``h, kind`` of the anchors that occur more than once."""
    same = F.col("lo") == F.col("hi")
    return written(anchor_rows(src, least, True).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("lo"), F.max("run").alias("hi"))
                   .where("n > 1").select("h", F.when(same, UNIFORM).when(F.col("n") > together, HOT).otherwise(MIXED).alias("kind")), "repeated-anchors")


def cells_of(segment: bytes, n: int, anchor: int, least: int) -> list[dict]:
    """The cells of a run: first window, hash of the bytes all windows of the cell share, of all its bytes, and of each window.

    ``anchor`` is the anchor's place in the segment; cells lie on a grid beside it.
    """
    from xxhash import xxh3_128_digest
    out, o = [], 0
    while o < n:
        cell = (anchor - o) // CELL
        end = min(n, anchor - CELL * cell + 1)  # after the cell's last window
        core = anchor - CELL * cell
        out.append({"o": o, "core": xxh3_128_digest(segment[core:core + least - CELL + 1] + bytes([cell])),
                    "whole": xxh3_128_digest(segment[o:end - 1 + least] + bytes([cell])),
                    "windows": [xxh3_128_digest(segment[i:i + least]) for i in range(o, end)]})
        o = end
    return out


def candidate_runs(src: DataFrame, repeated: DataFrame, least: int) -> DataFrame:
    """Runs of repeated anchors: ``_k, _t, first, n, kind, h, run, segment, cells``.

    The first time a task meets a run of an anchor that is not uniform, the row
    also carries the run's bytes, or its cells where the anchor is hot.
    """
    wanted = anchor_rows(src, least, False).join(repeated, "h").groupBy("_k").agg(F.collect_set(F.struct("h", "kind")).alias("wanted"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in batches:
            data, offsets = _bytes_of(b.column("_bytes"))
            flat = b.column("wanted").flatten()
            known, pick = np.unique(flat.field("h").to_numpy(), return_index=True)
            kinds = flat.field("kind").to_numpy()[pick]
            k, t = b.column("_k").to_numpy(), b.column("_t").to_numpy()
            for r in anchors.runs(data, offsets, least):
                h, run = r.h.view(np.int64), r.run.view(np.int64)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[place] == h)
                kind, h, run, text, first, n = kinds[place[hit]], h[hit], run[hit], r.text[hit], r.first[hit], r.n[hit]
                segments, cells = [None] * len(hit), [None] * len(hit)
                some = np.flatnonzero(kind != UNIFORM)
                _, one = np.unique(np.stack([h[some], run[some]], axis=1), axis=0, return_index=True) if len(some) else (None, [])
                for i in some[one].tolist():
                    if (key := (int(h[i]), int(run[i]))) in sent:
                        continue
                    sent.add(key)
                    at = int(offsets[text[i]] + first[i])
                    segment = data[at:at + int(n[i]) - 1 + least].tobytes()
                    if kind[i] == MIXED:
                        segments[i] = segment
                    else:
                        cells[i] = cells_of(segment, int(n[i]), int(r.anchor[hit[i]] - first[i]), least)
                if len(sent) > REMEMBERED:
                    sent.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[text], pa.int64()), pa.array(t[text], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32()),
                     pa.array(kind, pa.int32()), pa.array(h), pa.array(run), pa.array(segments, pa.binary()), pa.array(cells, arrow_cells)],
                    names=["_k", "_t", "first", "n", "kind", "h", "run", "segment", "cells"])

    arrow_cells = to_arrow_schema(StructType.fromDDL(f"cells {_CELLS}")).field(0).type
    return written(src.join(wanted, "_k").select("_k", "_t", "_bytes", "wanted").mapInArrow(
        rows, f"_k long, _t long, first long, n int, kind int, h long, run long, segment binary, cells {_CELLS}"), "candidate-runs")


def _covered(groups: Iterator[suffix.Repeat]) -> dict[int, list[dict[str, int]]]:
    """Joined byte ranges that repeats cover, by segment."""
    spans: dict[int, dict[int, int]] = {}
    for length, places in groups:
        for s, o in places:
            mine = spans.setdefault(s, {})
            mine[o] = max(mine.get(o, 0), o + length)
    out = {}
    for s, mine in spans.items():
        joined: list[dict[str, int]] = []
        for a in sorted(mine):
            if joined and a <= joined[-1]["b"]:
                joined[-1]["b"] = max(joined[-1]["b"], mine[a])
            else:
                joined.append({"a": a, "b": mine[a]})
        out[s] = joined
    return out


def mixed_ranges(candidates: DataFrame, least: int) -> DataFrame:
    """``h, run, ranges``: bytes of each distinct run that another run of its anchor repeats."""
    src = candidates.where("segment is not null").select("h", "run", "n", "segment")
    src = src.repartition(partitions(candidates.sparkSession), "h").sortWithinPartitions("h", "run")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            found = _covered(suffix.repeat_groups([x[3] for x in held], [x[2] for x in held], least))
            at = sorted(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i in at], pa.int64()), pa.array([held[i][1] for i in at], pa.int64()),
                 pa.array([found[i] for i in at], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["h", "run", "ranges"])

        for b in batches:
            for h, run, n, segment in zip(*(b.column(c).to_pylist() for c in ("h", "run", "n", "segment"))):
                if (h, run) == last:
                    continue
                if size >= SORTED_BYTES and h != last[0]:
                    yield solved()
                    held, size = [], 0
                held.append((h, run, n, segment))
                size, last = size + len(segment), (h, run)
        if held:
            yield solved()

    return src.mapInArrow(rows, f"h long, run long, ranges {_RANGES}")


def hot_ranges(candidates: DataFrame, least: int) -> DataFrame:
    """``h, run, ranges`` for the runs of hot anchors, from counts of their cells and windows."""
    cells = (candidates.where("cells is not null").select("h", "run", "cells").dropDuplicates(["h", "run"])
             .select("h", "run", F.explode("cells").alias("c")).select("h", "run", "c.*"))
    # a run has each of its cells and windows once: they lie at different places beside the anchor
    cores = cells.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    cells = written(cells.join(cores, "core", "left_semi"), "hot-cells")
    wholes = cells.groupBy("whole").agg(F.count(F.lit(1)).alias("times"), F.first("core").alias("core"), F.first("windows").alias("windows"))
    lone = wholes.where("times = 1")
    whole = (cells.join(wholes.where("times > 1").select("whole"), "whole", "left_semi")
             .select("h", "run", F.col("o").alias("a"), (F.col("o") + F.size("windows") - 1 + least).alias("b")))
    # windows of different cells, each cell once, where some cell of that core is still open
    pool = wholes.join(lone.select("core").distinct(), "core", "left_semi").select(F.explode("windows").alias("w"))
    found = pool.groupBy("w").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("w")
    one = (cells.join(lone.select("whole"), "whole", "left_semi").select("h", "run", "o", F.posexplode("windows").alias("i", "w"))
           .join(found, "w", "left_semi").select("h", "run", (F.col("o") + F.col("i")).alias("a"), (F.col("o") + F.col("i") + least).alias("b")))
    return whole.unionByName(one).groupBy("h", "run").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("ranges"))


def repeated_ranges(src: DataFrame, least: int = LEAST, together: int = TOGETHER) -> DataFrame:
    """``_k, _t, ranges``: the repeated byte ranges of every text that has some; they may overlap."""
    runs = candidate_runs(src, repeated_anchors(src, least, together), least)
    narrow = runs.select("_k", "_t", "first", "n", "kind", "h", "run")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1 + least).cast("long").alias("b")))
    often = narrow.where(F.col("kind") != UNIFORM).groupBy("h", "run").agg(F.count(F.lit(1)).alias("times"))
    found = mixed_ranges(runs, least).unionByName(hot_ranges(runs, least))
    known = written(often.join(found, ["h", "run"], "left").where("times > 1 or ranges is not null"), "known-runs")
    mixed = (narrow.where(F.col("kind") != UNIFORM).join(known, ["h", "run"])
             .select("_k", "_t", "first", F.when(F.col("times") > 1, whole).otherwise(F.col("ranges")).alias("r")))
    uniform = narrow.where(F.col("kind") == UNIFORM).select("_k", "_t", "first", whole.alias("r"))
    moved = uniform.unionByName(mixed).select("_k", "_t", F.transform("r", lambda x: F.struct((x["a"] + F.col("first")).alias("a"), (x["b"] + F.col("first")).alias("b"))).alias("r"))
    return moved.groupBy("_k", "_t").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def joined(ranges: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join(parts) + text[at:]


def _each_text(docs: DataFrame, least: int, together: int, columns: str, make) -> DataFrame:
    """``doc_id, n_bytes`` and what ``make(text, spans)`` gives for every row."""
    ranges = written(repeated_ranges(_source(docs), least, together), "ranges")
    both = _source(docs, "doc_id").join(ranges, ["_k", "_t"], "left").select("doc_id", "_bytes", "ranges")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, {columns}"
    made = list(to_arrow_schema(StructType.fromDDL(columns)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_bytes").to_pylist()
            out = [make(text, joined(r)) for text, r in zip(texts, b.column("ranges").to_pylist())]
            cols = list(zip(*out)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64())]
                                             + [pa.array(c, f.type) for c, f in zip(cols, made)], names=["doc_id", "n_bytes", *(f.name for f in made)])

    return both.mapInArrow(rows, schema)


def remove_repeats(docs: DataFrame, least: int = LEAST, together: int = TOGETHER) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges (array of a, b) and the remaining bytes of every row."""
    return _each_text(docs, least, together, f"spans {_RANGES}, kept binary",
                      lambda text, spans: ([{"a": a, "b": b} for a, b in spans], kept(text, spans)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_text(documents(spark, sf_dir), LEAST, TOGETHER, "n_removed long, n_spans long, kept_sha256 string",
                      lambda text, spans: (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(text, spans)).hexdigest()))
