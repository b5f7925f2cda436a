"""Property-based checks of the distributed rank machinery."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_signal.operators import linear, ranking

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(values=st.lists(st.one_of(st.integers(-5, 5), st.floats(allow_nan=False)), min_size=1, max_size=60),
       buckets=st.integers(2, 20), probs=st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_refined_quantiles_match_numpy(spark, values, buckets, probs):
    """Any finite or infinite values, with few parts a pass and nothing fetched."""
    (ranking.BUCKETS, ranking.FETCH), saved = (buckets, 1), (ranking.BUCKETS, ranking.FETCH)
    try:
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = ranking.exact_quantiles(df, ["x"], probs)["x"]
    finally:
        ranking.BUCKETS, ranking.FETCH = saved
    ordered = sorted(float(v) for v in values)
    for p, g in zip(probs, got):
        h = (len(ordered) - 1) * p
        lo, hi = ordered[int(h)], ordered[min(int(h) + 1, len(ordered) - 1)]
        want = lo if lo == hi or h == int(h) else lo + (h - int(h)) * (hi - lo)
        assert g == want or (np.isnan(g) and np.isnan(want))


@SETTINGS
@given(n=st.integers(1, 60), k=st.integers(2, 7))
def test_contiguous_fold_sizes_like_unshuffled_kfold(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("r"))
    sizes = {r["f"]: r["count"] for r in
             df.select(linear.contiguous_fold(F.col("r"), F.lit(n), k).alias("f")).groupBy("f").count().collect()}
    want = [n // k + (1 if i < n % k else 0) for i in range(k)]
    assert [sizes.get(i, 0) for i in range(k)] == want
