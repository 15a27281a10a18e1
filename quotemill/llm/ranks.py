"""Exact ranks of rows within groups that may be of any size: no group is ever in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def ranked(rows: DataFrame, group: str, order: list, name: str = "pos") -> DataFrame:
    """``rows`` with ``name``, their place from 0 in the order of ``order`` within ``group``, and ``n``, the group's rows.

    Rows are dealt by ranges of (group, order, a number of each row), so a group with many rows, even equal ones, spans several
    partitions; a place is the row's number there plus the rows of the group in the partitions before, from a table with a
    row for each group and partition. ``rows`` should be a written table, as ranges are found by a pass of their own; ``group`` has no nulls.
    Rows that are equal in ``order`` come in any order.
    """
    keys = [F.col(group), *order, F.monotonically_increasing_id()]
    keyed = rows.withColumns({f"__{i}": k for i, k in enumerate(keys)})
    names = [f"__{i}" for i in range(len(keys))]
    dealt = keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in names]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in names]).drop(*names)
    at = settle(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33).alias("__part")
    counts = at.groupBy(group, part).agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    w = Window.partitionBy(group)
    counts = settle(counts.select(F.col(group).alias("__group"), F.col("__part").alias("__own"), (F.sum("__c").over(w.orderBy("__part")) - F.col("__c") - F.col("__first")).alias("__shift"), F.sum("__c").over(w).alias("n")))
    found = at.join(counts, (F.col(group) == F.col("__group")) & (F.shiftrightunsigned("__at", 33) == F.col("__own")))
    return found.withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__group", "__own", "__shift")
