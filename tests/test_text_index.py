import random

from pyspark.sql import functions as F

from quillstat.operators import text_index as X


def rows(n, seed):
    r = random.Random(seed)
    return [(i, None if i % 17 == 0 else "".join(r.choice(["ab", "B", "c ", "dé", "😅", "\n", "The", "𝄞"]) for _ in range(r.randrange(0, 40)))) for i in range(n)] + [(n, "x" * 50_000 + "needle")]


def test_equals_contains(spark, tmp_path):
    data = rows(300, 1)
    df = spark.createDataFrame(data, "id long, body string")
    index = X.build(df, f"{tmp_path}/ix", ["id"], "body")
    for q in ("the", "THE", "thec", "ab", "", "b", "abB", "dé😅", "😅𝄞", "c\nab", "c ab", "not there", "needle", "xxneed", "bthethe", "é😅𝄞ab"):
        want = sorted(r["id"] for r in df.filter(F.lower("body").contains(q.lower())).collect())
        assert sorted(r["id"] for r in index.search(q).collect()) == want, q


def test_reads_only_matching_postings(spark, tmp_path):
    df = spark.createDataFrame(rows(200, 2), "id long, body string")
    index = X.build(df, f"{tmp_path}/ix", ["id"], "body")
    p = index.postings(["the"])
    read = {r["bucket"] for r in p.select("bucket").distinct().collect()}
    assert len(read) == 1 and {r["gram"] for r in p.select("gram").distinct().collect()} == {"the"}
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and ("EqualTo(gram,the)" in plan or "In(gram" in plan)
    # candidates are few where a gram is rare
    assert index.candidates("needle").count() == 1


def test_empty_table(spark, tmp_path):
    index = X.build(spark.createDataFrame([], "id long, body string"), f"{tmp_path}/ix", ["id"], "body")
    assert index.search("").count() == 0
