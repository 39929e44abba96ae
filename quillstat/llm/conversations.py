"""Conversation structure repair by prefix-doubling path ranking.

A conversation is the sequence of its rows by turn.  Role initials must read
``(s?(ua)+)?``: an optional system row, then user and assistant by turns, or
nothing.  A cost programming over (row, grammar state) finds the cheapest edits
(keep, delete, change of role, insertion of an empty row).  Among the cheapest
edits the least audit string (their initials) is taken: the nodes of optimal
arcs are ranked by the first 1, 2, 4, ... letters of their audits, each rank
made of the rank of a node and of the node that a doubled pointer reaches.  At
a node an initial leads to one next node only, so equal prefixes end at the
same node and one pointer a node is enough; the doubled pointers then spell out
the path.

No conversation has to fit in a task: rows are sorted over all tasks by
conversation and turn and cut into blocks of ``BLOCK`` rows.  Only the first and
last conversation of a block can go on elsewhere.  Their parts are summed up as
4 x 4 cost matrices, which give the costs at every cut; their paths are then
found for each state at the cut, and the parts are linked.  The repaired rows
are a stream in order, of which a task holds one batch.

Defined results: a null role or text counts as one space, a null id is a
conversation of its own; null turns come first; rows of one turn go by role,
then text; repeated rows are duplicates; other roles than s, u and a never fit
and are changed or deleted; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import conversations, written

#: Costs of the edits.  Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: 2 to this power rows make a block.
BLOCK_BITS = 12
_SPACE = r"[\x20\x09-\x0D]"
_FAR = 1 << 60

# Grammar states: before the first row, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The next state for an initial, and the initial that a changed or inserted row takes.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_WANT = "uuau"
_ROLE = {"u": "user", "a": "assistant"}
_GOES = tuple(_NEXT[s][_WANT[s]] for s in range(4))
_LETTERS = "DIKR"  # in ASCII order
#: Costs behind the last row, insertions included.
_END = (0, 2 * INSERT, INSERT, 0)


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the contract's damage, chosen by a checksum of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    t = table.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                     (F.crc32(key) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("_d") == 3, 1).otherwise(0)))
    return t.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("_again")).drop("_again")


def ordered(rows: DataFrame) -> DataFrame:
    """Written rows with ``pos``, which rises by conversation, turn, role and text over all tasks."""
    t = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = ["conv_id", "turn", "role"]
    # a prefix of the text orders as the text does and keeps the sample of the range partitioning small
    return written(t.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
                   .withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``pos, conv_id, turn, init, fault`` of ordered rows: fault is blank, duplicate, truncated or null."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(rf"[.!?]{_SPACE}*\z")
    t = turns.select("pos", "conv_id", "turn", "role", F.sha2("text", 256).alias("h"),
                     F.when(blank, "blank").when(~whole, "truncated").alias("own"))
    # the first of equal rows is found by its place, so a row that repeats often meets no join under one key
    first = t.groupBy("conv_id", "role", "h").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("own"))
    return t.join(first, "pos", "left").select("pos", "conv_id", "turn", F.substring("role", 1, 1).alias("init"), fault.alias("fault"))


def _arcs(init: str, fault: str | None, state: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of one row."""
    out = [(0, DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if init in _NEXT[state]:
            out.append((2, more, _NEXT[state][init]))
        out.append((3, REROLE + more, _GOES[state]))
    return out


def _with_insertions(base: list[int]) -> list[int]:
    """Costs before a row: one insertion leads on from a state, two lead nowhere new but from a system row."""
    u = min(base[USER], INSERT + base[ASSISTANT])
    return [min(base[START], INSERT + u), min(base[SYSTEM], INSERT + u), u, min(base[ASSISTANT], INSERT + base[USER])]


def costs(rows: list[tuple[str, str | None]], end: list[int], known: dict) -> list[list[int]]:
    """Least cost from each (row, state) to the end, whose costs are ``end``."""
    out = [list(end)]
    for r in reversed(rows):
        arcs = known.get(r)
        if arcs is None:
            arcs = known[r] = [_arcs(*r, s) for s in range(4)]
        g = out[-1]
        out.append(_with_insertions([min(c + g[t] for _, c, t in a) for a in arcs]))
    return out[::-1]


def ranked_pointers(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Optimal arcs ``target[node, letter]`` (-1: none) -> letter, rank and doubled pointers of each node.

    Level k ranks nodes by the first 2^k letters of their least audits; a node
    without arcs ends an audit and ranks first.  It ends when all audits do.
    """
    nodes, has = np.arange(len(target)), target >= 0
    ends = ~has.any(axis=1)
    letter = has.argmax(axis=1)
    pointer = np.where(ends, nodes, target[nodes, letter])
    rank = np.where(ends, 0, letter + 1)
    pointers = [pointer]
    while not ends[pointer].all():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
        pointer = pointer[pointer]
        pointers.append(pointer)
    return np.where(ends, -1, letter), rank, pointers


def _graph(rows: list, g: list[list[int]], last: bool, known: dict, at: int) -> np.ndarray:
    """Optimal arcs of one part; its node (i, state) has the number ``at + 4 * i + state``."""
    target = np.full((4 * len(g), 4), -1, np.int64)
    for i, now in enumerate(g):
        for s in range(4):
            n, c = 4 * i + s, now[s]
            if c >= _FAR:
                continue
            if i < len(rows):
                for letter, cost, t in known[rows[i]][s]:
                    if cost + g[i + 1][t] == c:
                        target[n, letter] = at + 4 * (i + 1) + t
            if (i < len(rows) or last) and INSERT + now[_GOES[s]] == c:
                target[n, 1] = at + 4 * i + _GOES[s]
    return target


def _audit(start: int, letter: np.ndarray, pointers: list[np.ndarray]) -> tuple[str, int]:
    """The letters on the path from ``start``, spelled by doubling, and its last node."""
    path = np.array([start])
    for p in pointers:
        if letter[path[-1]] < 0:
            break
        path = np.concatenate([path, p[path]])
    end = int(np.argmax(letter[path] < 0))
    return "".join(_LETTERS[x] for x in letter[path[:end]]), int(path[end])


def _parts(block: pa.Table) -> list[tuple[int, int, object, list]]:
    """(first position, last position, conversation, rows) of the parts of a block, in order."""
    b = block.sort_by("pos")
    pos, conv = b.column("pos").to_pylist(), b.column("conv_id").to_pylist()
    rows = list(zip(b.column("init").to_pylist(), b.column("fault").to_pylist()))
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    return [(pos[a], pos[z - 1], conv[a], rows[a:z]) for a, z in zip(cuts, cuts[1:])]


def _edges(block: pa.Table) -> pa.Table:
    """Cost matrices of the first and last part of a block: ``pos, conv_id, costs`` (from state, to state)."""
    parts, known = _parts(block), {}
    out = [parts[0], *parts[1:][-1:]]
    m = []
    for *_, rows in out:
        ways = [costs(rows, [0 if t == s else _FAR for t in range(4)], known)[0] for s in range(4)]
        m.append([min(_FAR, ways[e][s]) for s in range(4) for e in range(4)])
    return pa.table({"pos": pa.array([p[0] for p in out], pa.int64()), "conv_id": pa.array([p[2] for p in out], block.schema.field("conv_id").type),
                     "costs": pa.array(m, pa.list_(pa.int64()))})


def _cuts(parts: pa.Table) -> pa.Table:
    """Costs behind each part of one conversation: ``pos, first, last, behind``."""
    p = parts.sort_by("pos")
    end, behind = list(_END), []
    for m in reversed(p.column("costs").to_pylist()):
        behind.append(end)
        end = [min(_FAR, min(m[4 * s + e] + end[e] for e in range(4))) for s in range(4)]
    n = len(behind)
    return pa.table({"pos": p.column("pos"), "first": [i == 0 for i in range(n)], "last": [i == n - 1 for i in range(n)],
                     "behind": pa.array(behind[::-1], pa.list_(pa.int64()))})


_PATHS = "conv_id {}, pos long, edge boolean, state int, leaves int, cost long, audit string, illegal long, head string, tail string"


def _paths(block: pa.Table, cuts: pa.Table) -> pa.Table:
    """Least audits of the parts of a block, one for each state in which a part can be entered."""
    known: dict = {}
    edge = {p: (f, z, b) for p, f, z, b in zip(*(cuts.column(c).to_pylist() for c in ("pos", "first", "last", "behind")))}
    parts = _parts(block)
    graphs, at, found = [], [], []
    n = 0
    for first_pos, _, _, rows in parts:
        _, last, behind = edge.get(first_pos, (True, True, list(_END)))
        g = costs(rows, behind, known)
        graphs.append(_graph(rows, g, last, known, n))
        at.append((n, g))
        n += 4 * len(g)
    letter, _, pointers = ranked_pointers(np.concatenate(graphs))
    for (first_pos, _, conv, rows), (base, g) in zip(parts, at):
        first, _, _ = edge.get(first_pos, (True, True, None))
        init = [r[0] for r in rows]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(init, init[1:]))
        for s in [START] if first else range(4):
            if g[0][s] < _FAR:
                audit, end = _audit(base + s, letter, pointers)
                found.append((conv, first_pos, first_pos in edge, s, (end - base) % 4, g[0][s] if first else 0, audit, wrong, init[0], init[-1]))
    names = ["conv_id", "pos", "edge", "state", "leaves", "cost", "audit", "illegal", "head", "tail"]
    types = [block.schema.field("conv_id").type, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)


def _linked(parts: pa.Table) -> pa.Table:
    """``pos, state, more`` of one conversation: the state in which each part is entered, and illegal pairs at its start."""
    at = {(p, s): (to, h, t) for p, s, to, h, t in zip(*(parts.column(c).to_pylist() for c in ("pos", "state", "leaves", "head", "tail")))}
    out, state, before = [], START, None
    for p in sorted({p for p, _ in at}):
        to, head, tail = at[p, state]
        out.append((p, state, int(before is not None and before + head not in ("su", "ua", "au"))))
        state, before = to, tail
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("pos", "state", "more"), zip(*out), (pa.int64(), pa.int32(), pa.int64()))})


def audits(codes: DataFrame) -> DataFrame:
    """Rows of ``faults`` -> ``conv_id, pos, state, cost, audit, illegal`` per part of a conversation, ``pos`` its first row."""
    kind = codes.schema["conv_id"].dataType.simpleString()
    rows = codes.select(F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "conv_id", "init", "fault")
    edges = rows.groupBy("block").applyInArrow(_edges, f"pos long, conv_id {kind}, costs array<long>")
    cuts = edges.groupBy("conv_id").applyInArrow(_cuts, "pos long, first boolean, last boolean, behind array<long>")
    cuts = written(cuts.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "cuts")
    paths = written(rows.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_paths, _PATHS.format(kind)), "paths")
    linked = paths.where("edge").select("conv_id", "pos", "state", "leaves", "head", "tail").groupBy("conv_id").applyInArrow(
        _linked, "pos long, state int, more long")
    keep = ["conv_id", "pos", "state", "cost", "audit"]
    return paths.where("not edge").select(*keep, "illegal").unionByName(
        paths.where("edge").join(linked, ["pos", "state"]).select(*keep, (F.col("illegal") + F.col("more")).alias("illegal")))


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted parts (``state, audit``) and texts -> repaired rows, in order."""
    out: list[tuple] = []
    conv, line, state, audit, i, body = None, 0, START, "", 0, 0

    def emit(role, text):
        nonlocal line
        out.append((conv, line, role, text))
        line += 1

    def insertions():
        nonlocal i, state
        while i < len(audit) and audit[i] == "I":
            emit(_ROLE[_WANT[state]], "")
            state, i = _GOES[state], i + 1

    for b in batches:
        for c, is_first, s, a, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "is_first", "state", "audit", "role", "text"))):
            if a is not None:
                if is_first:
                    conv, line = c, 0
                state, audit, i, body = s, a, 0, len(a.rstrip("I"))
                continue
            insertions()
            letter, i = audit[i], i + 1
            if letter != "D":
                if letter == "R":
                    role = _ROLE[_WANT[state]]
                emit(role, text)
                state = _NEXT[state][role[:1]]
            if i == body:  # what follows the part's last row
                insertions()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out.clear()


def repaired_rows(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, line, role, text`` of the repaired conversations; a conversation's rows are in order within one partition."""
    kind = turns.schema["conv_id"].dataType
    # START is also a state behind deleted rows, so a conversation's first part is told by its place
    firsts = parts.groupBy("conv_id").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    none = F.lit(None).cast("string")
    edits = parts.join(firsts, "pos", "left").select(
        "conv_id", "pos", F.coalesce("is_first", F.lit(False)).alias("is_first"), "state", "audit", none.alias("role"), none.alias("text"))
    texts = turns.select("conv_id", "pos", F.lit(False).alias("is_first"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"), "role", "text")
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("audit").isNull())
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), ("line", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return both.mapInArrow(lambda bs: _repaired(bs, arrow), f"conv_id {kind.simpleString()}, line long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()])], names=["conv_id", "sha"])

    conv, h, ready = None, None, []
    for b in batches:
        for c, line, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "line", "role", "text"))):
            if line == 0:
                if h is not None:
                    ready.append(done())
                conv, h = c, hashlib.sha256()
            h.update(f"{chr(10) if line else ''}{role}:{text}".encode())
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            ready = []
    if h is not None:
        yield done()


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, turn, role, text``) -> a report a conversation, and its repaired rows.

    The report has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``; the rows are ``conv_id, line, role, text``.
    """
    turns = ordered(rows)
    codes = written(faults(turns), "faults")
    parts = written(audits(codes), "audits")
    found = codes.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == k).cast("long").alias(k) for k in ("blank", "duplicate", "truncated")))
    edits = parts.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    both = found.unionByName(edits, allowMissingColumns=True).groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return both, repaired_rows(turns, parts)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of rows in the order of ``repaired_rows``, read as a stream."""
    kind = repaired.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    return repaired.mapInArrow(lambda bs: _digests(bs, arrow), f"conv_id {kind.simpleString()}, sha string").withColumnRenamed("sha", "repaired_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = conversations(spark, sf_dir)
    report, rows = repair(damaged(table))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = table.select("conv_id").distinct()  # conversations that lost all rows too
    all_ = report.unionByName(digests(rows), allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    return all_.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
