"""Embedders that are column expressions."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.plans.queries import letter_embedder


def test_letters_are_counted_once(spark):
    """Of a text the embedder makes each count once, not once for each letter's quotient."""
    vec = letter_embedder().transform(spark.createDataFrame([("h", "Abba c"), ("e", "")], "content_hash string, text string"))
    assert vec._jdf.queryExecution().optimizedPlan().toString().count("replace(") <= 26
    got = {r["content_hash"]: r["vec"] for r in vec.collect()}
    assert np.allclose(got["h"][:4], np.array([2, 2, 1, 0]) / 3) and not any(got["e"]) and vec.agg(F.max(F.size("vec"))).first()[0] == 26
