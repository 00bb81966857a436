import gc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from akin.llm import shingles, tables


def test_a_worker_holds_the_state_of_one_operator():
    shingles.shingles("one two three four five six")
    memo = weakref.ref(shingles._word_hashes())
    assert len(memo()) == 6
    assert tables.kept("another operator", lambda: [1]) == [1]
    gc.collect()
    assert memo() is None
    assert len(shingles.shingles("one two three four five six")) == 2


def test_batches_are_bounded_in_bytes_while_a_table_is_written(spark):
    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    wide = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    rows = tables.written(wide.mapInArrow(measured, "n long, size long"), "measured").collect()
    assert sum(r["n"] for r in rows) == 300
    assert max(r["size"] for r in rows) < 2 * tables.MOST_BYTES
    assert spark.conf.get(tables.BATCH_BYTES, None) is None
    try:
        spark.conf.set(tables.BATCH_BYTES, "1m")
        tables.written(wide.mapInArrow(measured, "n long, size long"), "measured")
        assert spark.conf.get(tables.BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(tables.BATCH_BYTES)
