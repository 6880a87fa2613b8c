"""Positions and neighbours in ordered groups of any size.

A window over one group keeps that group in one task. Here the rows are range-partitioned by
(group, order) first, so a hot group is spread over many partitions; every window then sees only
one (group, partition) segment, and what crosses a segment's end comes from a summary that has one
row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsugumi.plans.bounds import checkpointed


def segmented(df: DataFrame, group: list[str], order: list[str], following: list[str] = (), sums: list[str] = (), preceding: list[str] = (), partitions: int | None = None, carried: list[str] = ()) -> DataFrame:
    """``df`` with ``pos`` (1, 2, ... in each group by ``order``) and ``next_<c>`` for each column c of ``following``,
     ``previous_<c>`` for each column c of ``preceding``, ``before_<c>``, the sum of c over the earlier rows of the group, for each column c of ``sums``,
     and ``last_<c>`` and ``coming_<c>``, the nearest value of c that is not null in an earlier and in a later row of the group, for each column c of ``carried``.

    ``order`` must be total within a group, or ties are numbered arbitrarily. Null group values form
    one group; null order values come first. An empty input gives an empty result.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both branches below must see the same partitions, whose bounds are sampled anew each time they are computed.
    parts = checkpointed(df.repartitionByRange(n, *group, *order).withColumn("__seg", F.spark_partition_id()))
    keys = [*group, "__seg"]
    own = Window.partitionBy(*keys).orderBy(*order)
    ahead = (Window.unboundedPreceding, -1)
    rows = parts.withColumns(
        {"__n": F.row_number().over(own)}
        | {f"__lead_{c}": F.lead(F.struct(c)).over(own) for c in following}
        | {f"__lag_{c}": F.lag(F.struct(c)).over(own) for c in preceding}
        | {f"__sum_{c}": F.coalesce(F.sum(c).over(own.rowsBetween(*ahead)), F.lit(0)) for c in sums}
        | {f"__last_{c}": F.last(c, ignorenulls=True).over(own.rowsBetween(*ahead)) for c in carried}
    )
    if carried:  # read backwards, as a frame that grows from behind would be summed up anew for every row
        rows = rows.withColumns({f"__coming_{c}": F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("__n")).rowsBetween(*ahead)) for c in carried})
    first = [F.min_by(F.struct(*following), F.col("__n")).alias("__first")] if following else []
    first += [F.max_by(F.struct(*preceding), F.col("__n")).alias("__end")] if preceding else []
    for c in carried:
        place = F.when(F.col(c).isNotNull(), F.col("__n"))
        first += [F.min_by(c, place).alias(f"__low_{c}"), F.max_by(c, place).alias(f"__high_{c}")]
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *first, *[F.sum(c).alias(f"__all_{c}") for c in sums])
    across = Window.partitionBy(*group).orderBy("__seg")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {"__before": F.coalesce(F.sum("__rows").over(earlier), F.lit(0))}
        | {f"__past_{c}": F.coalesce(F.sum(f"__all_{c}").over(earlier), F.lit(0)) for c in sums}
        | ({"__after": F.lead("__first").over(across)} if following else {})
        | ({"__ahead": F.lag("__end").over(across)} if preceding else {})
        | {f"__from_{c}": F.last(f"__high_{c}", ignorenulls=True).over(earlier) for c in carried}
        | {f"__to_{c}": F.last(f"__low_{c}", ignorenulls=True).over(Window.partitionBy(*group).orderBy(F.desc("__seg")).rowsBetween(*ahead)) for c in carried}
    ).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__before", "__rows", *[f"__past_{c}" for c in sums], *(["__after"] if following else []), *(["__ahead"] if preceding else []), *[f"__{x}_{c}" for c in carried for x in ("from", "to")])
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.join(summary, same)
    out = out.withColumns(
        {"pos": F.col("__before") + F.col("__n")}
        | {f"next_{c}": F.when(F.col("__n") == F.col("__rows"), F.col(f"__after.{c}")).otherwise(F.col(f"__lead_{c}.{c}")) for c in following}
        | {f"previous_{c}": F.when(F.col("__n") == 1, F.col(f"__ahead.{c}")).otherwise(F.col(f"__lag_{c}.{c}")) for c in preceding}
        | {f"before_{c}": F.col(f"__past_{c}") + F.col(f"__sum_{c}") for c in sums}
        | {f"last_{c}": F.coalesce(f"__last_{c}", f"__from_{c}") for c in carried}
        | {f"coming_{c}": F.coalesce(f"__coming_{c}", f"__to_{c}") for c in carried}
    )
    return out.select(*df.columns, "pos", *(f"next_{c}" for c in following), *(f"previous_{c}" for c in preceding), *(f"before_{c}" for c in sums), *(f"{x}_{c}" for c in carried for x in ("last", "coming")))
