import random
import re

from helpers_llm import awkward, docs_of
from pyspark.sql import functions as F

from quillstat.llm import simhash as H
from quillstat.llm.components import components


def plain(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    """Smallest id reachable over links of 2 bits or fewer; ``prints`` is (id, print)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    out = []
    for i in range(len(prints)):
        ids = [p[0] for j, p in enumerate(prints) if find(j) == find(i) and p[0] is not None]
        out.append(min(ids, default=None))
    return out


def test_awkward_rows(spark):
    rows = awkward() + [(30, "A b C d", "s"), (31, "a B c D", "s"), (32, "a b c e", "s")]
    got = H.near_duplicates(docs_of(spark, rows, extra=True)).collect()
    prints = [(i, plain(t)) for i, t, _ in rows]
    want = sorted(zip([p[0] for p in prints], [f"{p[1]:016x}" for p in prints], brute(prints)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want


def test_long_text_crosses_blocks():
    text = " ".join(f"w{i % 5003}" for i in range(2 * H._BLOCK + 11))
    assert H.fingerprint(text.encode()) & (1 << 64) - 1 == plain(text)


def test_links_are_all_pairs_within_two_bits(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(x["u"], x["v"]) for x in H.links(spark.createDataFrame([(s,) for s in signed], "_fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 2}
    assert got == want


def test_popcounts(spark):
    r = random.Random(9)
    values = [r.getrandbits(64) - (1 << 63) for _ in range(50)] + [0, -1, -(1 << 63), (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", H.segment_popcounts(F.col("v")).alias("c")).collect()
    for row in got:
        want = sum(bin((row["v"] >> 4 * i) & 15).count("1") << 4 * i for i in range(16))
        assert row["c"] == want


def test_components_of_a_long_chain(spark):
    e = [(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 400: 300, 500: 300}


def test_first_of_each_keeps_one_row(spark):
    a = " ".join(f"word{i}" for i in range(80))
    rows = [(5, a, "s"), (3, a, "t"), (3, a, "t"), (9, "quite other words here now", "s"), (None, "x y z", "s"), (None, "x y z", "s"), (10, "", None), (11, None, None)]
    docs = docs_of(spark, rows, extra=True)
    got = H.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([3, 9, 10, None], key=str)


def test_empty_table(spark):
    assert H.near_duplicates(docs_of(spark, [])).count() == 0
    assert H.first_of_each(docs_of(spark, [])).count() == 0
