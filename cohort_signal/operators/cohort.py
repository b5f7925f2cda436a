"""Cohort joins, partitions and labels.

Joins are single-key equi-joins; the physical strategy (sort-merge vs
broadcast) is left to the planner and AQE, which see real sizes at run time.
The N-way outer join of per-group tables (J3/J7) is rewritten as a union of
long rows plus one grouped pivot: one shuffle instead of N-1 joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "entity_id"


def merge(assessments: DataFrame, outcomes: DataFrame, key: str = KEY) -> DataFrame:
    """Inner join assessments x outcomes."""
    return assessments.join(outcomes, key, "inner")


def merge_counts(assessments: DataFrame, outcomes: DataFrame, key: str = KEY) -> DataFrame:
    """J1 bookkeeping in one full-outer aggregate: assessment rows, outcome
    rows, matched rows and outcome rows lost (no assessment)."""
    a = assessments.select(key, F.lit(1).alias("_a"))
    o = outcomes.select(key, F.lit(1).alias("_o"))
    j = a.join(o, key, "full")
    return j.agg(
        F.count("_a").alias("n_assessment_rows"),
        F.count("_o").alias("n_outcome_rows"),
        F.count_if(F.col("_a").isNotNull() & F.col("_o").isNotNull()).alias("n_merged"),
        F.count_if(F.col("_a").isNull()).alias("n_outcome_lost"))


def current_cohort(assessments: DataFrame, outcomes: DataFrame, key: str = KEY) -> DataFrame:
    """Entities with assessments and no outcome (anti-join)."""
    return assessments.join(outcomes.select(key), key, "left_anti")


def outer_merge(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Full outer join on the key (key coalesced by ``using``)."""
    return left.join(right, key, "full")


def long_scores(tables: Mapping[str, DataFrame], key: str = KEY,
                name_col: str | None = "name") -> DataFrame:
    """Union the per-group wide tables as long (key, name, feature, value)
    rows (the first step of J3/J7)."""
    parts = []
    for order, df in enumerate(tables.values()):
        feats = [c for c in df.columns if c not in (key, name_col)]
        nm = F.col(name_col) if name_col and name_col in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.col(key), nm.alias("_name"), F.lit(order).alias("_order"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in feats
        ])).alias("_kv")).select(key, "_name", "_order", "_kv.feature", "_kv.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pivot_long(long: DataFrame, features: Sequence[str], key: str = KEY,
               with_name: bool = True) -> DataFrame:
    """Second step of J3/J7: one grouped pivot back to wide; the name is the
    entity's first non-null name in the order of the groups."""
    aggs = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    if with_name:
        first = F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("_order"))) if "_order" in long.columns else F.min("_name")
        aggs = [first.alias("name")] + aggs
    return long.groupBy(key).agg(*aggs)


def nway_outer(tables: Mapping[str, DataFrame], key: str = KEY) -> DataFrame:
    """Every entity of any group with all groups' columns (null where
    the entity is absent)."""
    feats = [c for df in tables.values() for c in df.columns if c not in (key, "name")]
    return pivot_long(long_scores(tables, key), feats, key)


def merge_tagged(rows: DataFrame, group: str, groups: Sequence[str], values: Sequence[str], key: str = KEY) -> DataFrame:
    """J3 from tagged rows, one per entity and group, in one aggregate however
    many groups: every entity with a value in any group, its first name in the
    order of the groups, and ``<group>_<value>`` columns, null where absent."""
    order = F.lit(None).cast("int")
    for i, g in enumerate(groups):
        order = F.when(F.col(group) == g, F.lit(i)).otherwise(order)
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull() & F.col(group).isin(list(groups))
    return rows.filter(some).groupBy(key).agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), order)).alias("name"),
        *[F.max(F.when(F.col(group) == g, F.col(v))).alias(f"{g}_{v}") for g in groups for v in values])


def attach_tagged(rows: DataFrame, features: Sequence[str], key: str = KEY, tag: str = "feature", value: str = "value", base: str = "base") -> DataFrame:
    """J7 from tagged rows, (key, tag, value): one row per entity of the base
    (a row tagged ``base``) with a column per feature, null where it has none;
    one aggregate instead of a join per feature."""
    wide = rows.groupBy(key).agg(F.max((F.col(tag) == base).cast("int")).alias("_base"),
                                 *[F.max(F.when(F.col(tag) == f, F.col(value))).alias(f) for f in features])
    return wide.filter("_base = 1").drop("_base")


def distinct_members(rows: DataFrame, group: str, groups: Sequence, key: str = KEY) -> DataFrame:
    """U2 from tagged rows: the distinct keys of any of the groups, one scan."""
    return rows.filter(F.col(group).isin(list(groups))).select(key).distinct()


def coalesce_update(base: DataFrame, update: DataFrame, cols: Sequence[str], key: str = KEY) -> DataFrame:
    """Left join new values, keep the old value where the new one is
    null (a re-run never erases data)."""
    u = update.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = base.join(u, key, "left")
    return j.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in base.columns
                          else F.col(f"_new_{c}") for c in cols}).drop(*[f"_new_{c}" for c in cols])


def attach_scores(report: DataFrame, scores: DataFrame, key: str = KEY) -> DataFrame:
    """Left join raw scores back to a report, dropping the duplicate name."""
    return report.join(scores.drop("name"), key, "left")


def known_outcome(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """P13."""
    return df.filter(F.col(outcome).isNotNull())


def cohort_partition(has_assessments: Column, has_outcome: Column) -> Column:
    """Both / assessments_only / outcome_only."""
    return (F.when(has_assessments & has_outcome, "both")
            .when(has_assessments, "assessments_only")
            .when(has_outcome, "outcome_only"))


def retake_flag(n_attempts: str = "n_attempts") -> Column:
    """Needed a retake (more than one attempt), for entities with >= 1."""
    return (F.col(n_attempts) > 1).cast("int")


def pass_flag(outcome: str | Column, threshold: float) -> Column:
    """P19."""
    c = F.col(outcome) if isinstance(outcome, str) else outcome
    return c >= F.lit(threshold)


def stack_cohorts(historical: DataFrame, current: DataFrame) -> DataFrame:
    """Vertical concat by column name."""
    return historical.unionByName(current, allowMissingColumns=True)


def distinct_keys(*frames: DataFrame, key: str = KEY) -> DataFrame:
    """Union of distinct keys."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def key_difference(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of ``left`` missing from ``right`` (EXCEPT DISTINCT on keys;
    planned as a left-anti join on the key plus a distinct)."""
    return left.select(key).subtract(right.select(key))
