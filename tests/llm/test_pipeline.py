from helpers_llm import awkward, docs_of

import corpus_pipeline as C


def test_stages_keep_the_columns(spark, tmp_path):
    base = "plain words that nobody minds at all in a long calm text about rivers and hills number "
    rows = [(1000 + i, base + " ".join(f"t{i}x{k}" for k in range(30)), "ab"[i % 2]) for i in range(40)]
    rows += [(1100, rows[0][1], "a"), (1101, "my token = abcdef123456 stays private " + " ".join(f"u{k}" for k in range(20)), "b")]
    docs = docs_of(spark, rows + awkward(200), extra=True)
    spark.createDataFrame([(1000 + i, 0, 1) for i in range(30)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in at.select("doc_id").collect()]
        if name == "toxicity":
            assert len(ids) == docs.count()  # nothing toxic here
        if name == "simhash":
            assert 1100 not in ids and ids.count(7) == 1 and set(range(1000, 1040)) <= set(ids)
        if name == "secrets":
            assert not at.where("text like '%abcdef123456%'").count() and 1101 in ids
        if name == "mixing":
            assert max(map(ids.count, set(ids))) <= 2
    packed = C.STAGES[-1][1](spark, at, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.where("start = 0").count() == at.count()


def test_run(spark, sf001):
    from pyspark.sql import functions as F
    got = C.run(spark, sf001).agg(F.countDistinct("doc_id").alias("d"), F.sum("length").alias("n")).first()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").count()
    assert 0 < got["d"] <= docs and got["n"] > 0
