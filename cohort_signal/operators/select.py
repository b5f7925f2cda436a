"""Feature selection rules on the schema (P11, P12); driver-only, no job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

# Never features.
EXCLUDED = ("entity_id", "name", "outcome")
EXAM_MARKERS = ("midterm", "final")
EXAM_EXCLUDE = ("outcome", "date", "attempt", "score")


def numeric_features(df: DataFrame, exclude: Iterable[str] = EXCLUDED) -> list[str]:
    """Numeric columns minus key/name/outcome, in schema order."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def exam_features(columns: Iterable[str], markers=EXAM_MARKERS, exclude=EXAM_EXCLUDE) -> list[str]:
    """Names containing a marker and none of the excluded words."""
    return [c for c in columns if any(m in c for m in markers) and not any(x in c for x in exclude)]


def group_features(columns: Iterable[str], token: str, suffix: bool = False) -> list[str]:
    """P12 group rule: case-folded contains (or endswith) ``token``."""
    t = token.lower()
    return [c for c in columns if (c.lower().endswith(t) if suffix else t in c.lower())]
