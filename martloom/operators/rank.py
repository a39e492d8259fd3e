"""Whole-table ranking without moving the table to one task.

A window without ``partitionBy`` sends every row to a single task. Here the
rows are range-partitioned on the full order (which ends in a unique key, so
even a third of all rows sharing one value is cut into several ranges), sorted
inside each range and written once. A row's place is then its place inside its
range plus the sizes of the ranges before it; that table of range sizes has one
row per range, whatever the data size, and is what gets broadcast.

Running sums and dense ranks are summed up inside the sorted ranges on their way
to that one write, so they need no window and no second shuffle: what a range
adds is read off its last row. A dense rank counts changes of value; whether a
range begins with a change shows in the last value of the range before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martloom.session import stage

_LOCAL_BITS = 33  # monotonically_increasing_id: upper bits partition, lower 33 bits row
_POS = "__pos"
_PART = "__part"
_UNIT = 10**9  # running sums are carried as whole numbers in two parts, exact up to 9e27


def _scaled(df: DataFrame, source: str) -> Column:
    """A whole-number or decimal column as a whole number of its last decimal; NULL adds nothing."""
    kind = df.schema[source].dataType
    if not isinstance(kind, (T.IntegralType, T.DecimalType)):
        raise TypeError(f"no exact running sum of {source}: {kind.simpleString()}")
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    value = F.col(source).cast(f"decimal(38,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    return F.coalesce(value.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _unscaled(high: Column, low: Column, df: DataFrame, source: str) -> Column:
    """The value of two summed parts, in the type that a sum of the column has."""
    kind = df.schema[source].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    whole = high.cast("decimal(28,0)") * F.lit(_UNIT).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    summed = df.select(F.sum(source).alias("s")).schema["s"].dataType
    return (whole.cast("decimal(38,0)") / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(summed) if scale else whole.cast(summed)


def _followed(ranged: DataFrame, parts: list[str], dense: list[str]) -> DataFrame:
    """Sorted ranges with sums of ``parts`` so far (in place) and, for ``dense``, the changes of value so far."""
    changed = [f"__changes_{c}" for c in dense]
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(c, T.LongType()) for c in changed]])

    def follow(batches):
        total, changes, last = dict.fromkeys(parts, 0), dict.fromkeys(dense, 0), dict.fromkeys(dense)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns))
            for c in parts:
                sums = np.cumsum(columns[c].to_numpy(zero_copy_only=False)) + total[c]
                total[c] = int(sums[-1])
                columns[c] = pa.array(sums)
            for c, name in zip(dense, changed):
                values = columns[c]
                # Codes in order of appearance; equal neighbours have equal codes, NULL is a value.
                codes = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new = np.concatenate([[last[c] is None or not last[c].equals(values[0])], codes[1:] != codes[:-1]])
                counts = np.cumsum(new) + changes[c]
                changes[c], last[c] = int(counts[-1]), values[len(values) - 1]
                columns[name] = pa.array(counts)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return ranged.mapInArrow(follow, schema)


def global_rank(
    df: DataFrame,
    order: list[Column],
    rank: str = "rn",
    running: dict[str, str] | None = None,
    total: str | None = None,
    grand: dict[str, str] | None = None,
    dense: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``rank`` (1..n in ``order``), running sums, dense ranks and whole-table totals.

    ``running`` maps a new column to the column it accumulates, ``grand`` a new
    column to one of those, giving its last value; ``total`` names the row
    count. ``dense`` maps a new column to the column whose values it numbers;
    ``order`` must begin with that column. ``order`` must end in a unique key for
    the numbering to be fixed.
    """
    running, grand, dense = running or {}, grand or {}, dense or {}
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [f"__{half}_{name}" for name in running for half in ("high", "low")]
    split = {}
    for name, source in running.items():
        high = F.floor(_scaled(df, source) / F.lit(_UNIT).cast("decimal(10,0)")).cast("bigint")
        split[f"__high_{name}"] = high
        split[f"__low_{name}"] = (_scaled(df, source) - high.cast("decimal(28,0)") * F.lit(_UNIT).cast("decimal(10,0)")).cast("bigint")
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(_POS, F.monotonically_increasing_id())
    if running or dense:
        ranged = _followed(ranged.withColumns(split), parts, list(dense.values()))
    # Written, not cached: a range boundary drawn anew would move rows.
    pinned = stage(ranged, "rank").withColumn(_PART, F.shiftright(_POS, _LOCAL_BITS))
    changes = [f"__changes_{c}" for c in dense.values()]
    ends = [F.max_by(c, _POS).alias(f"__of_{c}") for c in [*parts, *changes]]
    edges = [f(c, _POS).alias(f"__{n}_{c}") for c in dense.values() for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    sizes = pinned.groupBy(_PART).agg(F.count(F.lit(1)).alias("__size"), *ends, *edges)
    # One row per range.
    by_range, whole = Window.orderBy(_PART), Window.partitionBy()
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    for c in dense.values():
        # A range that goes on with the value that the one before ended in begins with no change.
        goes_on = F.col(f"__first_{c}").eqNullSafe(F.lag(f"__last_{c}").over(by_range)) & F.lag(F.lit(1)).over(by_range).isNotNull()
        sizes = sizes.withColumn(f"__goes_on_{c}", F.when(goes_on, 1).otherwise(0))

    def before(c: str | Column) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    offsets = sizes.select(
        F.col(_PART).alias("__range"),
        before("__size").alias("__before"),
        F.sum("__size").over(whole).alias("__all"),
        *[before(f"__of_{c}").alias(f"__before_{c}") for c in parts],
        *[F.sum(f"__of_{c}").over(whole).alias(f"__all_{c}") for c in parts],
        *[
            (before(F.col(f"__of___changes_{c}") - F.col(f"__goes_on_{c}")) - F.col(f"__goes_on_{c}")).alias(f"__before___changes_{c}")
            for c in dense.values()
        ],
    )
    placed = pinned.join(F.broadcast(offsets), F.col(_PART) == F.col("__range"))
    local = F.col(_POS).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    columns = [F.col(c) for c in df.columns] + [(local + F.col("__before") + 1).alias(rank)]
    if total:
        columns.append(F.col("__all").alias(total))
    for new, name in grand.items():
        columns.append(_unscaled(F.col(f"__all___high_{name}"), F.col(f"__all___low_{name}"), df, running[name]).alias(new))
    for name, source in running.items():
        halves = [F.col(f"__{half}_{name}") + F.col(f"__before___{half}_{name}") for half in ("high", "low")]
        columns.append(_unscaled(*halves, df, source).alias(name))
    columns += [(F.col(f"__changes_{c}") + F.col(f"__before___changes_{c}")).alias(new) for new, c in dense.items()]
    return placed.select(*columns)


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """Per distinct value: rows with it, rows below it, and its dense place."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("same"))
    return (
        global_rank(counts, [F.asc(value)], rank="dense", running={"up_to": "same"})
        .withColumn("below", F.col("up_to") - F.col("same"))
        .drop("up_to")
    )


def dense_ranks(df: DataFrame, value: str, name: str, key: str) -> DataFrame:
    """Dense rank of ``value``, largest first; ``key`` is unique and only keeps ranges of one value apart."""
    return global_rank(df, [F.desc(value), F.asc(key)], rank="__rn", dense={name: value}).drop("__rn")
