"""Running values per key that survive hot keys.

A window over one key is one task. Here every key is cut into buckets of its order (normally time
buckets): each bucket is aggregated on its own, the few bucket rows of a key give the carry into each
bucket, and the rows of a bucket only add their local running value to the carry. A key that holds a
third of all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, count, max or last (latest non-null)."""

    out: str
    kind: str
    value: Column | None = None
    inclusive: bool = True


def time_bucket(ts: str, seconds: int = 86_400) -> Column:
    """Number of the ``seconds``-wide bucket a timestamp falls in."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000))


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, specs: list[Running]) -> DataFrame:
    """Add running values over ``keys`` in ``order``; ``bucket`` must not decrease along ``order``."""
    work = df.withColumn("_bucket", bucket)
    partials, carries, finals = [], [], []
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local_order = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    for spec in specs:
        part, carry = f"_p_{spec.out}", f"_c_{spec.out}"
        local = local_order.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        if spec.kind in ("sum", "count"):
            value = F.lit(1).cast("long") if spec.kind == "count" else spec.value
            partials.append(F.sum(value).alias(part))
            carries.append(F.coalesce(F.sum(part).over(before), F.lit(0)).alias(carry))
            finals.append((spec.out, F.coalesce(F.sum(value).over(local), F.lit(0)) + F.col(carry)))
        elif spec.kind == "max":
            partials.append(F.max(spec.value).alias(part))
            carries.append(F.max(part).over(before).alias(carry))
            finals.append((spec.out, F.greatest(F.max(spec.value).over(local), F.col(carry))))
        elif spec.kind == "last":
            at = F.struct(*[F.col(c) for c in order])
            partials.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), at)).alias(part))
            carries.append(F.last(part, ignorenulls=True).over(before).alias(carry))
            finals.append((spec.out, F.coalesce(F.last(spec.value, ignorenulls=True).over(local), F.col(carry))))
        else:
            raise ValueError(f"unknown running kind {spec.kind!r}")
    join_keys = [*keys, "_bucket"]
    carry_in = work.groupBy(*join_keys).agg(*partials).select(*join_keys, *carries)
    for key in join_keys:
        carry_in = carry_in.withColumnRenamed(key, f"_k_{key}")
    same = [work[key].eqNullSafe(carry_in[f"_k_{key}"]) for key in join_keys]
    result = work.hint("merge").join(carry_in, same)
    return result.select(*df.columns, *[expr.alias(name) for name, expr in finals])
