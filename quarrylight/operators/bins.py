"""Places of numbers among thresholds, for models that only compare numbers with thresholds."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDLESS = float("inf")


def with_bins(df: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Add `_bin_<column>`: how many of a column's rising thresholds lie below the value; -1 for NaN.

    A value that equals a threshold lies at or below it, as in MLlib's trees. Bucketizer counts an equal
    one as above, so it gets both with their signs changed; 0 - x knows no negative zero.
    """
    cut = {c: t for c, t in thresholds.items() if len(t)}
    out = df.withColumns({f"_bin_{c}": F.lit(0) for c in thresholds if c not in cut})
    if not cut:
        return out
    turned = out.withColumns({f"_neg_{c}": F.lit(0.0) - F.col(c) for c in cut})
    buckets = Bucketizer(
        inputCols=[f"_neg_{c}" for c in cut], outputCols=[f"_bin_{c}" for c in cut], handleInvalid="keep",
        splitsArray=[[-ENDLESS, *[0.0 - float(x) for x in reversed(t)], ENDLESS] for t in cut.values()],
    )
    return buckets.transform(turned).withColumns(
        {f"_bin_{c}": (F.lit(len(t)) - F.col(f"_bin_{c}")).cast("int") for c, t in cut.items()}
    ).drop(*[f"_neg_{c}" for c in cut])


def packed(thresholds: dict[str, list[float]]) -> list[Column]:
    """The bins of with_bins as few whole numbers: rows with equal numbers have equal bins."""
    keys, size = [], 0
    for name, limits in thresholds.items():
        here, n = F.col(f"_bin_{name}").cast("long") + 1, len(limits) + 2
        if keys and size * n < 1 << 62:
            keys[-1], size = keys[-1] * n + here, size * n
        else:
            keys, size = [*keys, here], n
    return keys or [F.lit(0).cast("long")]
