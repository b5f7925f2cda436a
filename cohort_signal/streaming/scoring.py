"""Incremental early-warning scoring with Structured Streaming.

The batch pipeline fits everything it needs (training medians, the clip
range, engineered features, linear coefficients) into constants; applying
them is a stateless per-row projection.  The same expressions therefore run
unchanged on a streaming DataFrame: current-cohort rows that arrive as files
are imputed, scored, rounded and flagged as they land, with exactly-once
output through a file sink and a checkpoint in the shared checkpoint
folder.  No state store is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import linear, risk
from ..plans import pipelines as pl
from ..session import scratch_path

KEY = "entity_id"


@dataclass
class FrozenScorer:
    """Everything fitted on the training cohort, as driver-side constants."""
    prep: pl.Prepared
    fit: linear.LinearFit
    threshold: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Batch or streaming rows with the raw score columns -> report rows."""
        t = pl.apply_preprocess(rows, self.prep)
        scored = t.select(KEY, "name", risk.rounded_prediction(self.fit.predict()).alias("predicted"))
        return risk.flag_at_risk(scored, self.threshold)


def fit_scorer(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> FrozenScorer:
    """Fit the early-warning model on the historical cohort (Q1 + Q2 + M2)."""
    from ..sources import fixtures
    _, _, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, list(fixtures.SCORE_COLUMNS))
    fit = pl.train_linear(prep)
    return FrozenScorer(prep, fit, fixtures.OUTCOME_THRESHOLD if threshold is None else threshold)


def start_scoring(spark: SparkSession, scorer: FrozenScorer, source_dir: str, schema,
                  sink_dir: str | None = None, checkpoint_dir: str | None = None,
                  available_now: bool = True) -> tuple[StreamingQuery, str]:
    """Score parquet files arriving in ``source_dir``; write flagged rows to
    ``sink_dir`` (parquet, append).  Returns the query and the sink path."""
    sink_dir = sink_dir or scratch_path(spark, "risk_stream_out")
    checkpoint_dir = checkpoint_dir or scratch_path(spark, "risk_stream_ckpt")
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = (scorer.score(stream).writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), sink_dir
