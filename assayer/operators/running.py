"""Running totals that never put a whole series into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import join_small, stored

#: Totals that one window runs over.
FANOUT = 1024


def running_totals(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str]
) -> DataFrame:
    """Add ``<value>_before`` and ``<value>_through`` running sums per key.

    Rows are cut into ranges of (keys, order) of about equal size, so that a key
    with most rows has most ranges. Sums run inside a range; what stands before
    it comes from the ranges' totals, one row for each range and key, which are
    carried over in levels of ``FANOUT``. Ties in ``order`` run in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are drawn from a sample: both must see the same rows, and once.
    ranged = stored(
        stored(rows, "running-rows")
        .repartitionByRange(parts, *keys, *order)
        .withColumn("__part", F.spark_partition_id()),
        "running-ranges",
    )
    return running_totals_in_parts(ranged, keys, order, values)


def running_totals_in_parts(
    ranged: DataFrame, keys: list[str], order: list[str], values: list[str]
) -> DataFrame:
    """``running_totals`` of rows whose ``__part`` numbers ranges of ``order``; it is read twice.

    Rows that are dealt by ``__part`` are not exchanged again.
    """
    sums = {value: f"__{value}" for value in values}
    totals = stored(
        ranged.groupBy(*keys, "__part").agg(*[F.sum(v).alias(s) for v, s in sums.items()]), "running-totals"
    )
    parts = (totals.agg(F.max("__part")).first()[0] or 0) + 1
    offsets = carried(totals, keys, "__part", list(sums.values()), parts)
    through = (
        Window.partitionBy(*keys, "__part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.withColumns({f"__l_{v}": F.sum(v).over(through) for v in values})
    joined = join_small(local, offsets, [*keys, "__part"])
    return joined.withColumns(
        {f"{v}_through": F.col(s) + F.col(f"__l_{v}") for v, s in sums.items()}
        | {f"{v}_before": F.col(s) + F.col(f"__l_{v}") - F.col(v) for v, s in sums.items()}
    ).drop("__part", *sums.values(), *[f"__l_{v}" for v in values])


def carried(
    totals: DataFrame, keys: list[str], place: str, values: list[str], size: int
) -> DataFrame:
    """The sum of ``values`` over all smaller places of a key, of places under ``size``.

    No window sees more than ``FANOUT`` rows of a key: beyond, groups of places
    are summed, carried in the same way, and added to the sums inside a group.
    """
    if size <= FANOUT:
        before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys, place, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values]
        )
    group = f"{place}_"
    grouped = totals.withColumn(group, F.expr(f"`{place}` div {FANOUT}"))
    above = carried(
        grouped.groupBy(*keys, group).agg(*[F.sum(v).alias(v) for v in values]),
        keys,
        group,
        values,
        -(-size // FANOUT),
    )
    before = Window.partitionBy(*keys, group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.select(
        *keys, place, group, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values]
    )
    renamed = above.select(*keys, group, *[F.col(v).alias(f"{v}_up") for v in values])
    return join_small(inside, renamed, [*keys, group]).select(
        *keys, place, *[(F.col(v) + F.col(f"{v}_up")).alias(v) for v in values]
    )
