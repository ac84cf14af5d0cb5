"""What a worker of the corpus operators holds at once does not grow with the number or length of the texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import kk_packing, pii_crf
from spanloom.llm.common import BATCH_BYTES, BATCH_SETTING


@pytest.mark.parametrize("stage", [pii_crf.redact, kk_packing.pack])
def test_batches_between_jvm_and_workers_are_bounded(spark, stage):
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "64m")
    try:
        docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), 20_000).alias("text"))
        stage(docs)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

        found = docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
        assert sum(r["rows"] for r in found) == 300
        assert max(r["bytes"] for r in found) < BATCH_BYTES + 200_000
        spark.conf.set(BATCH_SETTING, "1m")
        stage(docs)
        assert spark.conf.get(BATCH_SETTING) in ("1m", "1048576b")
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_viterbi_of_long_sequences_takes_little_memory():
    crf = pii_crf.default_crf()
    rng = np.random.default_rng(3)
    long = [rng.integers(0, len(crf.index), n) for n in rng.integers(3000, 4000, 200)]
    tracemalloc.start()
    together = crf.decode(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for k in (0, 77, 199):
        assert (crf.decode([long[k]])[0] == together[k]).all()
