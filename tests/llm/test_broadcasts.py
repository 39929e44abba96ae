"""Tables that grow with the documents are never broadcast, however small Spark takes them to be."""

from pyspark.sql import functions as F

from quillstat.llm import components, phrases, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch, *modules):
    """Plans of what the modules write from now on."""
    plans = []
    for m in modules:
        def spy(df, what="table", put=m.written):
            plans.append(plan(df))
            return put(df, what)
        monkeypatch.setattr(m, "written", spy)
    return plans


def near_copies(spark):
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}_"), F.floor(F.col("id") / 5).cast("string")) for i in range(40)])
    return spark.range(40).select(F.col("id").alias("doc_id"), F.concat(words, F.when(F.col("id") % 5 == 1, " more").otherwise("")).alias("text"))


def test_fingerprints_and_their_grid_points_are_shuffled(spark, monkeypatch):
    plans = recorded(monkeypatch, simhash, components)
    docs = near_copies(spark)
    out = simhash.near_duplicates(docs)
    plans.append(plan(out))
    assert {r["component_id"] for r in out.collect()} <= set(range(40)) and out.count() == 40
    kept = simhash.first_of_each(docs)
    plans.append(plan(kept))
    assert kept.count() == out.select("component_id").distinct().count()
    assert sum("SortMergeJoin" in p for p in plans) >= 8
    assert not [p for p in plans if "Broadcast" in p]


def test_links_of_a_chain_are_shuffled(spark, monkeypatch):
    plans = recorded(monkeypatch, components)
    links = spark.range(20).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i, 0) for i in range(1, 21)}
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def test_phrases_meet_salted_words_in_a_shuffle(spark):
    texts = [("en", "new york city is new york city again. old york")] * 12 + [(None, "la paz la paz la paz")] * 11
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    out = phrases.collocations(phrases.phrase_counts(docs))
    text = plan(out)
    assert text.count("SortMergeJoin") >= 8 and "Broadcast" not in text
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"]) for r in out.collect()}
    assert got["en", "old york"] == (12, 12, 36, 120) and got["und", "la paz la"][0] == 22


def test_the_pipeline_drops_near_copies_without_broadcasts(spark, monkeypatch):
    import corpus_pipeline
    plans = recorded(monkeypatch, simhash, components)
    out = corpus_pipeline.drop_near_copies(spark, near_copies(spark), "")
    plans.append(plan(out))
    assert out.count() < 40 and not [p for p in plans if "Broadcast" in p]


def test_links_of_a_hub_are_dealt_to_several_keys(spark, monkeypatch):
    plans = recorded(monkeypatch, components)
    links = spark.range(1, 200).select((F.col("id") + 1000).alias("u"), F.lit(7).cast("long").alias("v"))
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i + 1000, 7) for i in range(1, 200)}
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert joins and all("_salt" in line for p in joins for line in p.splitlines() if "SortMergeJoin" in line)
