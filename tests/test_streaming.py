"""The streaming scorer gives the same report as the batch pipeline."""

from conftest import SF001


def test_stream_scoring_matches_batch(spark):
    from cohort_signal.operators import cohort
    from cohort_signal.plans.pipelines import early_warning
    from cohort_signal.session import scratch_path
    from cohort_signal.sources import fixtures as fx
    from cohort_signal.streaming.scoring import fit_scorer, start_scoring

    scorer = fit_scorer(spark, SF001)
    current = cohort.current_cohort(fx.wide_scores(spark, SF001), fx.outcomes(spark, SF001))
    src = scratch_path(spark, "arrivals")
    # rows arrive as several files
    current.repartition(3).write.parquet(src)
    q, sink = start_scoring(spark, scorer, src, current.schema)
    q.awaitTermination(120)
    got = {r["entity_id"]: (r["predicted"], r["risk_score"], r["at_risk"]) for r in spark.read.parquet(sink).collect()}
    want = {r["entity_id"]: (r["predicted"], r["risk_score"], r["at_risk"]) for r in early_warning(spark, SF001).collect()}
    assert got == want and len(got) > 0
