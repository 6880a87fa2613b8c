"""Written times of records in mixed forms and zones as UTC instants, and the zones that records imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsugumi.functions.instants import known_zones, shifted, with_instant

OFFSET_DAY_US = 86_400_000_000


def fit_zones(rows: DataFrame, group: list[str], local: str, lower: str, upper: str, candidates: DataFrame) -> DataFrame:
    """For each group of records whose local times lack a zone, the offset history that fits best.

    ``lower`` and ``upper`` are UTC microseconds between which a record must lie, taken from its
    neighbours in sequence or from its ingestion time (null: no bound). ``candidates`` has a column
    ``zone``; names that the JVM's rules lack are passed over. A candidate violates a record if the converted time is outside the bounds or the clock
    there skips the local time. Result: group columns, ``zone``, ``records``, ``bounded`` (those with a
    bound; the others tell skipped times only), ``violations``, ``rank`` (1 is chosen; ties go to the name that sorts first, UTC before all). Records with a null
    local time count nowhere. Each record meets each of the few candidates on its own executor; only
    counts are shuffled, at most groups x candidates of them.
    """
    known = rows.sparkSession.createDataFrame([(z,) for z in known_zones(rows.sparkSession)], "zone string")  # the rules' own names, some 600
    zones = candidates.select("zone").distinct().join(F.broadcast(known), "zone", "left_semi")  # so at most as many, whatever the candidates
    listed = F.broadcast(zones.agg(F.sort_array(F.collect_set("zone")).alias("_zones")))
    each = rows.filter(F.col(local).isNotNull()).select(*group, local, lower, upper).crossJoin(listed).withColumn("zone", F.explode("_zones")).drop("_zones")
    guess = F.col(local) - (shifted(F.col(local) - OFFSET_DAY_US, F.col("zone")) - (F.col(local) - OFFSET_DAY_US))
    late = F.col(local) - (shifted(F.col(local) + OFFSET_DAY_US, F.col("zone")) - (F.col(local) + OFFSET_DAY_US))
    within = lambda u: F.coalesce(u >= F.col(lower), F.lit(True)) & F.coalesce(u <= F.col(upper), F.lit(True))
    real = lambda u: shifted(u, F.col("zone")) == F.col(local)
    # Where the offset is the same a day before and after, no change is near and the time exists.
    each = each.withColumns({"_guess": guess, "_late": late})
    a, b = F.col("_guess"), F.col("_late")
    fits = F.when(a == b, within(a)).otherwise((within(a) & real(a)) | (within(b) & real(b)))
    counted = each.groupBy(*group, "zone").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.coalesce(lower, upper)).alias("bounded"), F.sum(F.when(fits, 0).otherwise(1)).alias("violations")
    )
    order = Window.partitionBy(*group).orderBy("violations", F.col("zone") != "UTC", "zone")
    return counted.withColumn("rank", F.row_number().over(order))


def normalised(rows: DataFrame, value: str, zone: str, keys: list[str], fitted: DataFrame | None = None, group: list[str] = ()) -> DataFrame:
    """``keys`` and ``utc_us`` of every row of ``rows`` whose ``value`` denotes one instant.

    The zone of values without one is column ``zone``; where that is null, the zone that
    ``fit_zones`` chose for the row's group, if ``fitted`` is given; else UTC. See
    ``with_instant`` for what gives no row.
    """
    rows = rows.select(*dict.fromkeys([*keys, value, zone, *group]))
    if fitted is not None:
        chosen = fitted.filter("rank = 1").select(*group, F.col("zone").alias("_fit"))
        rows = rows.join(chosen, list(group), "left").withColumn(zone, F.coalesce(F.col(zone), F.col("_fit")))
    return with_instant(rows, value, zone).filter(F.col("utc_us").isNotNull()).select(*keys, "utc_us")
