"""Mixing sources to target weights by systematic sampling.

A document of source s is expected ``target(s) / size(s)`` times in the mix.
Inside its source these expectations are summed up document by document, one
random offset is added, and a document is emitted once per whole number that
the sum crosses at it. Documents stand in order of size, so what a source takes
differs from its target by little more than its largest document.

Defined results: a null text or one without words has size 0 and is drawn like
any other document; a source of size 0 has target 0 and gives nothing; a null
source is a source, the last one; a source without a weight has weight 0; equal
rows are rows of their own; a text of any length is one row; an empty table gives an empty mix. All columns of
the documents are carried, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.llm.common import named, packed, positions, table, unpacked, word_count
from martloom.session import stage

SHARE = 1.5  # of all words
MOST = 2.0  # times a source
SEED = 20
CYCLE = (5, 2, 1)
MANY = 1_000_000  # sources; a row each, in one task


def cycle_weights(sources: DataFrame, cycle=CYCLE) -> DataFrame:
    """(source, weight): the weights in turn, by source name, null last.

    One row per source: this is the list that somebody writes by hand.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    return sources.select("source").distinct().select("source", chosen.alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size) and (source, weight).

    Targets are proportional to weights and sum to ``share`` of all sizes. None
    exceeds ``most`` times its source; what is over goes to the others by weight.
    With the sources ordered by the level at which they fill up, the right level
    is the one left at the first source that it does not fill. One row per source.
    """
    found = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
    rows = found.select(
        F.col("s.source").alias("source"),
        F.col("s.source_size").alias("source_size"),
        F.coalesce(F.col("w.weight"), F.lit(0.0)).alias("weight"),
        (F.col("s.source_size") * F.lit(float(most))).alias("cap"),
    )
    fills = Window.orderBy(
        F.expr("try_divide(cap, weight)").asc_nulls_last(), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(fills), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fills), F.lit(0.0))
    rows = rows.select("*", left.alias("left"), weight_left.alias("weight_left")).withColumn(
        "level", F.expr("try_divide(left, weight_left)")  # null where only weights of 0 are left
    )
    open_level = F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))
    # Levels rise up to the first open source and fall behind it, so the highest open level is that one's.
    level = F.max(open_level).over(everything)
    filled = F.coalesce(level, F.col("level"))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * filled, F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, size, weights: DataFrame, share: float = SHARE, most: float = MOST,
        seed: int = SEED, source: str = "source", order: str = "doc_id") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``copies``; its columns in ``row``.

    ``size`` is a column expression. Exact: a source's expected copies are whole
    numbers of 10^-12, so every document gets the floor or ceiling of them.
    """
    rows = docs.select(
        packed(docs), named(source).alias("source"), size.alias("size"), named(order).alias("tie")
    )
    ranked = positions(rows, ["source"], ["size", "tie"], "place")
    sizes = stage(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    if sizes.count() > MANY:
        warnings.warn(f"more than {MANY} sources: weights and targets are worked out in one task", stacklevel=2)
    goal = targets(sizes, weights, share, most)
    # md5, so that SQL can draw the same offset.
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    offset = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") % 1_000_000
    goal = goal.select(
        "source", "source_size", "target",
        F.coalesce(F.expr("try_divide(target, source_size)"), F.lit(0.0)).cast("decimal(16,12)").alias("rate"),
        (offset.cast("decimal(10,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(8,6)").alias("offset"),
    )
    both = ranked.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    after = F.floor((F.col("place") + 1).cast("decimal(20,0)") * F.col("rate") + F.col("offset"))
    before = F.floor(F.col("place").cast("decimal(20,0)") * F.col("rate") + F.col("offset"))
    return both.select(
        "row", F.col("d.source").alias("source"), "size", "source_size", "target",
        (after - before).cast("long").alias("copies"),
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it was drawn."""
    drawn = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return drawn.select(*unpacked(drawn, columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Narrow and written once: the texts are read a single time.
    narrow = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = mix(narrow, F.col("size"), cycle_weights(narrow))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents of the mix, repeats as rows of their own.

    Only ids and sizes are ranked; the texts meet their copy counts by id, so
    they are dealt once at most and not in order of their length.
    """
    numbered = docs.select(packed(docs), F.monotonically_increasing_id().alias("id"), word_count(F.col("text")).alias("size"))
    pinned = stage(numbered, "mix-documents")
    narrow = pinned.select("id", F.col("row").getField("source").alias("source"), "size", F.col("row").getField("doc_id").alias("doc_id"))
    mixed = mix(narrow, F.col("size"), cycle_weights(narrow))
    drawn = mixed.where("copies > 0").select(F.col("row.id").alias("id"), "copies")
    return emit(pinned.select("row", "id").join(drawn, "id"), docs.columns)


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5.0, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT))::DOUBLE AS weight,
         CAST(sum(size) AS BIGINT) * 2.0::DOUBLE AS cap
  FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM totals
), levels AS (SELECT *, left_over / weight_left AS level FROM filled),
goal AS (
  SELECT source, source_size,
         least(cap, weight * coalesce(max(CASE WHEN cap > weight * level THEN level END) OVER (), level)) AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place,
         CAST(coalesce(g.target / nullif(g.source_size, 0), 0) AS DECIMAL(16,12)) AS rate,
         CAST((CAST('0x' || substr(md5('20:' || coalesce('s' || d.source, 'n')), 1, 8) AS BIGINT) % 1000000) AS DECIMAL(10,0))
           * CAST(0.000001 AS DECIMAL(7,6)) AS shift
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(CAST(place AS DECIMAL(18,0)) * rate + shift) - floor(CAST(place - 1 AS DECIMAL(18,0)) * rate + shift) AS BIGINT) * size AS taken
FROM placed
"""
