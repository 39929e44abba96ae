import json

from pyspark.sql import functions as F

from quillstat.sources import page_chains as P

SCHEMA = "post_id string, place string, value string"


def page(url, nxt, *ids):
    return json.dumps({"url": url, "data": [{"id": i, "message": f"m {i}", "from": {"id": "u", "name": "U"}, "created_time": "2024-08-20T10:05:00+0000"} for i in ids],
                       "paging": {"next": nxt} if nxt else {}})


LANDED = [("p", "f1", page("a1", "a2", "c1", "c2")), ("p", "f2", page("a2", "a3", "c3")), ("p", "f3", page("a3", None, "c4")),
          ("p", "f4", page("b1", "gone", "c5")), ("p", "f5", '{"url": "x", "data": [{"id": "c9'), ("p", "f6", ""), ("p", "f7", None), ("p", "f8", '{"error": 1}'),
          ("q", "g1", page("r1", "r2", "d1")), ("q", "g2", page("r2", "r3", "d2")), ("q", "g3", page("r3", "r2", "d3", "d1")),  # runs into a cycle
          ("q", "g4", page("s1", "s1", "d4")),  # points to itself
          ("q", "g5", page("t1", None, "d5")), ("q", "g6", page("t1", None, "d5", "d6")),  # landed again, longer
          (None, "h1", page("v1", None, "e1"))]


def test_good_rows_are_kept_and_damage_is_reported(spark):
    comments, bad, chains = P.ingest(spark.createDataFrame(LANDED, SCHEMA), post_id="alone")
    assert sorted((r["post_id"], r["comment_id"]) for r in comments.collect()) == sorted(
        [("p", f"c{i}") for i in range(1, 6)] + [("q", f"d{i}") for i in range(1, 7)] + [("alone", "e1")])
    assert {(r["place"], r["reason"]) for r in bad.collect()} == {("f5", "unreadable"), ("f6", "empty"), ("f7", "empty"), ("f8", "no data"), ("g5", "repeated")}
    got = {(r["post_id"], r["head"]): (r["pages"], r["comments"], r["status"], r["missing"]) for r in chains.collect()}
    assert got[("p", "a1")] == (3, 4, "complete", None) and got[("p", "b1")] == (1, 1, "broken", "gone")
    assert got[("q", "r1")][2] == "cyclic" or ("q", "r2") in got
    assert got[("q", "s1")] == (1, 1, "cyclic", None) and got[("q", "t1")] == (1, 2, "complete", None)


def test_long_chains_take_few_rounds(spark):
    n = 300
    rows = [("p", f"f{i}", page(f"k{i:04d}", f"k{i + 1:04d}" if i < n - 1 else None, f"c{i}")) for i in range(n)]
    rows += [("p", f"z{i}", page(f"z{i:04d}", f"z{(i + 1) % 70:04d}", f"y{i}")) for i in range(70)]  # a cycle
    got = {r["head"]: (r["pages"], r["comments"], r["status"]) for r in P.chains(P.parsed_pages(spark.createDataFrame(rows, SCHEMA))[0]).collect()}
    assert got == {"k0000": (300, 300, "complete"), "z0000": (70, 70, "cyclic")}


def test_files_and_empty_folders(spark, tmp_path):
    for post, place, value in LANDED[:5]:
        f = tmp_path / "in" / f"post_id={post}" / f"{place}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(value)
    comments, bad, chains = P.ingest(P.landed_pages(spark, f"{tmp_path}/in"))
    assert comments.count() == 5 and bad.count() == 1 and chains.count() == 2
    assert bad.first()["place"].endswith("f5.json") and bad.first()["sample"].startswith('{"url"')
    empty = spark.createDataFrame([], SCHEMA)
    assert [t.count() for t in P.ingest(empty)] == [0, 0, 0]


def test_no_table_of_pages_goes_through_the_driver(spark):
    rows = [("p", f"f{i}", page(f"k{i}", f"k{i + 1}" if i % 5 else None, f"c{i}")) for i in range(40)]
    for t in P.ingest(spark.createDataFrame(rows, SCHEMA)):
        assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()
    good, bad = P.parsed_pages(spark.createDataFrame(rows, SCHEMA))
    assert "SortMergeJoin" in good._jdf.queryExecution().executedPlan().toString()
