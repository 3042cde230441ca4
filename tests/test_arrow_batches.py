"""Python workers get long rows a few at a time, whatever the session's own bound."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import registry

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@F.pandas_udf(T.LongType())
def together(texts: pd.Series) -> pd.Series:
    return pd.Series([len(texts)] * len(texts))


@pytest.mark.parametrize("name", ["page_markdown", "code_index", "image_links", "code_index_text"])
def test_batches_of_a_query_are_bounded_in_bytes(spark, sf_dir, name):
    own = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "64m")
        registry.QUERIES[name](spark, sf_dir)
        rows = spark.range(3000).coalesce(1).select(together(F.rpad(F.col("id").cast("string"), 10_000, "x")).alias("n"))
        assert rows.agg(F.max("n")).first()[0] <= 600
        spark.conf.set(KEY, "1m")  # a lower one stays
        registry.QUERIES[name](spark, sf_dir)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, own)


@pytest.mark.parametrize("name", ["code_index", "code_index_text"])
def test_a_go_file_is_scanned_once_for_types_and_once_for_functions(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
