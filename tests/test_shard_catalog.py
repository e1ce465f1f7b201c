import os

import pytest
from pyspark.sql import functions as F

from lexmill import queries
from lexmill.operators import index as ix

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_shards_come_from_ids_without_a_join(spark):
    found = queries.QUERIES["shard_catalog"](spark, DATA)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == found.distinct().count() > 0


def test_a_null_id_is_in_the_last_shard_as_in_sql(spark):
    rows = spark.createDataFrame([(0,), (9,), (None,)], "doc_id long")
    assert [r[0] for r in rows.select(ix.shard_of(F.col("doc_id"), F.lit(10), 4)).collect()] == [0, 3, 3]
