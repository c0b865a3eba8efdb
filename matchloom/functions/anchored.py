"""Anchored windows: the first value of a key opens a window, and so does the first value beyond the open one's width.

Which value opens a window depends on all openers before it. Here every value points to the one that would open the
next window if it opened one itself, and the openers are what the first value reaches along these pointers. They are
followed in jumps of doubling length, so a key with a third of all rows takes as many tasks as any other rows, and
rounds grow with the logarithm of its windows. Both sides of a join grow with the input and are small on disk for what
they hold, so they are sorted and merged, never sent whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rounds of joins after which the lineage is cut.
_ROUNDS = 3


def _pointers(nodes: DataFrame, width: float, strict: bool) -> DataFrame:
    """``(_k, _from, _to)``: the least value of the key that is at least (more than, if ``strict``) ``width`` further.

    Values and the places looked for are sorted together in buckets one width wide; where the rest of a bucket has no
    value, the first one of the key's next filled bucket answers.
    """
    step = width if width > 0 else 1
    place = F.col("v") + F.lit(width)
    kind = nodes.schema["v"].dataType
    values = nodes.select("_k", F.floor(F.col("v") / step).alias("_b"), F.col("v").alias("_p"), F.lit(-1 if strict else 1).alias("_o"), F.col("v").alias("_at"), F.lit(None).cast(kind).alias("_from"))
    sought = nodes.select("_k", F.floor(place / step).alias("_b"), place.cast(kind).alias("_p"), F.lit(0).alias("_o"), F.lit(None).cast(kind).alias("_at"), F.col("v").alias("_from"))
    both = values.unionByName(sought)
    rest = Window.partitionBy("_k", "_b").orderBy("_p", "_o").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_near", F.first("_at", ignorenulls=True).over(rest)).filter("_from is not null").select("_k", "_b", "_from", "_near")
    ahead = Window.partitionBy("_k").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    further = both.groupBy("_k", "_b").agg(F.min("_at").alias("_low")).select("_k", "_b", F.first("_low", ignorenulls=True).over(ahead).alias("_far"))
    return near.hint("merge").join(further, ["_k", "_b"]).select("_k", "_from", F.coalesce("_near", "_far").alias("_to")).filter("_to is not null")


def openers(points: DataFrame, keys: list[str], value: str, width: float, strict: bool = False) -> DataFrame:
    """``(*keys, value)`` of the values that open a window; a value ``width`` (or more than it, if ``strict``) behind an
    opener opens the next. Null values open nothing; null keys are keys. Intermediate tables are stored."""
    nodes = points.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).alias("v")).distinct()
    nodes = stored(nodes, "anchored-values")
    per = nodes.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), ((F.max("v") - F.min("v")) / (width if width > 0 else 1)).alias("span"))
    most = per.agg(F.max(F.least(F.col("n").cast("double"), F.col("span") + 1 if width > 0 else F.col("n").cast("double")))).first()[0]
    rounds = int(most or 0).bit_length()
    hops = stored(_pointers(nodes, width, strict), "anchored-hops")
    reached = nodes.groupBy("_k").agg(F.min("v").alias("v"))
    for r in range(rounds):
        step = hops.select(F.col("_k").alias("_h"), "_from", "_to")
        more = reached.hint("merge").join(step, (reached["_k"] == step["_h"]) & (reached["v"] == step["_from"])).select("_k", F.col("_to").alias("v"))
        reached = reached.unionByName(more)
        if r + 1 < rounds:
            hops = hops.hint("merge").join(step.select("_h", F.col("_from").alias("_mid"), F.col("_to").alias("_end")), (F.col("_k") == F.col("_h")) & (F.col("_to") == F.col("_mid"))).select("_k", "_from", F.col("_end").alias("_to"))
        if r % _ROUNDS == _ROUNDS - 1 and r + 1 < rounds:
            reached, hops = stored(reached, "anchored-reached"), stored(hops, "anchored-hops")
    return reached.select("_k.*", F.col("v").alias(value))
