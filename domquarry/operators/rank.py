"""Row numbers inside groups that may be hot.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts a whole group in one
task.  ``row_number_within`` splits it: rows are range-partitioned on
``(g, o)`` (a hot group spans many partitions) and written once, with the
partition each row is in; they are numbered inside (partition, group) and
shifted by the row counts of the same group in earlier partitions -- a small
table of one row per (partition, group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def row_number_within(df: DataFrame, group: str | list[str], order: str, out: str = "rn") -> DataFrame:
    """1-based position of each row inside its ``group`` by ``order``
    (``order`` must be unique inside a group)."""
    group = [group] if isinstance(group, str) else group
    # written once: the numbering and the counts see the same partitions
    placed = materialize(df.repartitionByRange(*group, order).withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).drop("_cnt")
    local = placed.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(order)))
    same = F.col("a._pid") == F.col("b._pid")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return local.alias("a").join(offsets.alias("b"), same).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col("a._lrn") + F.col("b._off")).alias(out))
