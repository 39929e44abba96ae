import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quillstat.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string, audit string, line int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


def blanked(x):
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{blanked(conv)}:{blanked(turn)}".encode()) % 20
        role, text = blanked(role), blanked(text)
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain(rows):
    """One conversation by exhaustive search: report fields and repaired rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, fault = set(), []
    for _, _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, at, inserted):
        ways = [(0, "", ())] if i == len(rows) and at in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (at, role[0]) in step:
                    c, a, r = best(i, step[at, role[0]], inserted + 1)
                    ways.append((c + 3, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, at, 0)
            ways.append((c + 4, "D" + a, r))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] == "truncated" else 0
                for letter, cost, to in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if (at, to[:1]) in step:
                        c, a, r = best(i + 1, step[at, to[:1]], 0)
                        ways.append((c + cost + more, letter + a, ((to, text), *r)))
        return min(ways, default=(10 ** 9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    init = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(init, init[1:]))
    return (gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit), out


def want(rows):
    hurt, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        report, lines = plain([r for r in hurt if r[0] == conv])
        out[conv] = (*report, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = C.query(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in found}


def random_rows(n, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    texts = ["Yes.", "no", " ", "", None, "What?\n", "a. b", "ok!", "line\nbreak."]
    return [(r.randrange(n // 9), r.choice([*range(12), None]), r.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < .5 else f"t{r.random()}.")
            for _ in range(n)]


@pytest.mark.parametrize("bits", [12, 2])
def test_equals_exhaustive_search(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)  # blocks of 4 rows: conversations in many parts
    rows = random_rows(400, bits)
    assert got(spark, rows, tmp_path) == want(rows)


def test_one_hot_conversation_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 4)
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["fine.", "cut", f"x{t}!"])) for t in range(150)] + random_rows(100, 9)
    rows += [(None, t, "user", f"n{t}.") for t in range(5)]
    assert got(spark, rows, tmp_path) == want(rows)


def test_same_rows_in_one_turn_and_lost_conversations(spark, tmp_path):
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(1, None, "user", "same.")] * 9 + [(2, 0, "user", "z" * 300_000 + "."), (2, 1, "assistant", "w " * 200_000), (lost, 0, "user", "gone.")]
    found = got(spark, rows, tmp_path)
    assert found == want(rows)
    assert found[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, tmp_path):
    assert got(spark, [], tmp_path) == {}


def test_test_table(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in C.query(spark, sf001).collect()}
    assert found == want(rows)


def test_repaired_rows_fit_the_grammar(spark):
    rows = random_rows(200, 3)
    _, lines = C.repair(table(spark, rows))
    by = {}
    for r in sorted(lines.collect(), key=lambda r: r["line"]):
        by.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())


def test_ranks_order_audits():
    import numpy as np
    # 0 -D-> 1 -K-> 3(end); 0 -K-> 2; 2 -I-> 3
    target = np.full((4, 4), -1)
    target[0, 0], target[0, 2], target[1, 2], target[2, 1] = 1, 2, 3, 3
    letter, rank, pointers = C.ranked_pointers(target)
    assert C._audit(0, letter, pointers) == ("DK", 3)
    assert rank[3] < rank[0] < rank[2] < rank[1]
