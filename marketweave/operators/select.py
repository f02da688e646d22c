"""Exact quantiles per group by selection, without sorting the rows.

A quantile sketch per group brackets each wanted position between two values;
a second pass counts, for each group, the rows between the brackets and the
rows of each distinct value inside them; the value at a position is read off
those counts. What is written is a bracket's distinct values: about 4 in
``accuracy`` of a group's rows, however many these are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def grouped_quantiles(rows: DataFrame, group: str, value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """One row per group (a dimension-sized key; null is a group): group, n and
    ``q`` (array: the quantiles at ``probs``, linear interpolation). ``rows`` is
    read twice. Null values don't count; a group without values has no row.

    The sketch's error bound makes the brackets right; should one miss its
    position all the same, the selection is done again with a finer sketch.
    """
    v = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    while True:
        edge = 2.0 / accuracy
        around = sorted({min(max(p + e, 0.0), 1.0) for p in probs for e in (-edge, edge)})
        cuts = v.groupBy("_g").agg(F.percentile_approx("_v", around, F.lit(accuracy)).alias("_cuts"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        at = {p: (around.index(min(max(p - edge, 0.0), 1.0)), around.index(min(max(p + edge, 0.0), 1.0))) for p in probs}
        # of a group of fewer rows than ``accuracy`` all distinct values are counted
        ends = lambda i, all_, bound: F.when(F.lit(around[i] == bound) | (F.col("_n") < accuracy), F.col(all_)).otherwise(F.get("_cuts", F.lit(i)))
        cuts = cuts.select("_g", F.array(*[F.struct(ends(a, "_lo", 0.0).alias("a"), ends(b, "_hi", 1.0).alias("b")) for a, b in at.values()]).alias("_in"))
        cuts = materialize(cuts, "brackets")  # one row per group
        held = v.join(F.broadcast(cuts.withColumnRenamed("_g", "_h")), F.col("_g").eqNullSafe(F.col("_h")))
        inside = F.exists("_in", lambda s: F.col("_v").between(s["a"], s["b"]))
        below = F.size(F.filter("_in", lambda s: F.col("_v") > s["b"]))
        counts = materialize(held.groupBy("_g", below.alias("_slot"), F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c")), "counts")
        order = Window.partitionBy("_g").orderBy("_slot", F.col("_v").asc_nulls_first())  # rows before a bracket, then its values
        upto = counts.withColumns({"_upto": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                   "_n": F.sum("_c").over(Window.partitionBy("_g"))})
        place = lambda p: F.lit(p) * (F.col("_n") - 1)
        on = lambda k: F.max(F.when((F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto")), F.col("_v")))
        found = upto.groupBy("_g").agg(F.max("_n").alias("_n"), *[f(place(p)).alias(f"_{s}{i}") for i, p in enumerate(probs)
                                                                  for s, f in (("l", lambda x: on(F.floor(x))), ("h", lambda x: on(F.ceil(x))))])
        found = materialize(found, "quartiles")
        names = [f"_{s}{i}" for i in range(len(probs)) for s in "lh"]
        if found.filter(" OR ".join(f"{c} IS NULL" for c in names)).isEmpty():
            part = lambda p: place(p) - F.floor(place(p))
            q = [F.col(f"_l{i}") + part(p) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, p in enumerate(probs)]
            return found.select(F.col("_g").alias(group), F.col("_n").alias("n"), F.array(*q).alias("q"))
        accuracy *= 10
