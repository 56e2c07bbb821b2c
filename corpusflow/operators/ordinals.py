"""Running totals and dense numbers that stay spread out when one group holds most of the rows."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusflow.session import stage, truncate_lineage


@F.pandas_udf(T.StructType([T.StructField("run", T.LongType()), T.StructField("before", T.LongType())]))
def _along_runs(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Per row of a task the first position of its run, and the sum of the values before it in that run.

    A run is of rows of one group that come one after another, each at the position next to the one before.
    """
    group = at = run = None
    total = 0
    for groups, positions, values in rows:
        names, places, sizes = groups.to_numpy(), positions.to_numpy(np.int64), values.to_numpy(np.int64)
        if not len(places):
            yield pd.DataFrame({"run": places, "before": sizes})
            continue
        begins = np.ones(len(places), bool)
        begins[1:] = (names[1:] != names[:-1]) | (places[1:] != places[:-1] + 1)
        begins[0] = run is None or names[0] != group or places[0] != at + 1
        before = np.cumsum(sizes) - sizes
        last = np.maximum.accumulate(np.where(begins, np.arange(len(places)), -1))
        inside = before - np.where(last >= 0, before[last], -total)
        runs = np.where(last >= 0, places[last], run if run is not None else 0)
        yield pd.DataFrame({"run": runs, "before": inside})
        group, at, run, total = names[-1], int(places[-1]), int(runs[-1]), int(inside[-1] + sizes[-1])


def running_total_of_runs(df: DataFrame, group: str, position: str, value: str, out: str, work: str) -> DataFrame:
    """``running_total`` by one column for rows that mostly come in runs of neighbouring positions: none of them moves.

    ``position`` is unique within its group. The rows are stored in the scratch folder ``work``, which fixes the runs. Of
    rows in any other order the result is the same, but there are as many runs as rows.
    """
    of_run = _along_runs.asNondeterministic()(F.col(group), F.col(position).cast("long"), F.col(value).cast("long"))
    rows = df.dropna(subset=[group, position]).withColumn("_in", of_run)
    placed = stage(f"{work}/rows", rows.select(*df.columns, F.col("_in.run").alias("_run"), F.col("_in.before").alias("_before")))
    totals = placed.groupBy(group, "_run").agg(F.sum(value).alias("_total"))
    bases = dense_order(totals, [group], [F.col("_run")], "_total", "_base").select(group, "_run", "_base")
    # Stored, so that the optimizer sees how few they are.
    bases = stage(f"{work}/runs", bases)
    return placed.join(bases, [group, "_run"]).select(*df.columns, (F.col("_base") + F.col("_before")).alias(out))


def running_total(df: DataFrame, groups: list[str], position: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier positions of the same group.

    ``position`` is any integer, unique within its group, however far apart; rows where it or a group column is null
    are left out. Ranges of positions are cut by the data, so that one large group is spread like many small ones.
    """
    return dense_order(df.dropna(subset=[*groups, position]), groups, [F.col(position)], value, out)


def dense_order(
    df: DataFrame, groups: list[str], order: list[Column], weight: str, out: str, part: str | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over earlier rows of the group in any sortable order.

    Rows are range-partitioned and checkpointed, which fixes the partitions; totals per (group, partition) then
    give each partition its base. A group may span any number of partitions. ``part`` names a column that keeps the
    partition's number: it grows along the order, and further passes can go by it.
    """
    ranged = truncate_lineage(
        df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(*groups, "_part")
        .agg(F.sum(weight).alias("_sum"))
        .select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    kept = [F.col("_part").alias(part)] if part else []
    return local.join(bases, [*groups, "_part"]).select(
        *df.columns, (F.col("_base") + F.col("_local")).cast("long").alias(out), *kept
    )
