import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("quillstat-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstat-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


def make_comments(spark, rows):
    """rows: dicts with any comment columns; conformed + enriched."""
    from quillstat.operators.enrich import enrich
    from quillstat.sources.comments import conform
    import pandas as pd
    pdf = pd.DataFrame(rows)
    for c in pdf.columns:
        pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    df = spark.createDataFrame(pdf) if len(pdf) else None
    df = conform(df)
    return enrich(df)
