"""Full rankings without a task that holds all documents of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of score that are ranked apart, and bits of id within which documents without score are.
STEPS, ID_BITS = 1000, 16
#: Cuts of a scale that are found from the rows themselves, and their relative error.
CUTS, CUT_ERROR = 256, 0.0005


def cuts_of(rows: DataFrame, column: str) -> list[float]:
    """Places that cut a column's values into CUTS parts of about equal size; a short list, whatever the number of rows."""
    return sorted(set(rows.stat.approxQuantile(column, [i / CUTS for i in range(1, CUTS)], CUT_ERROR)))


def cell_of(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts are not above the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)


def stable_rank(scores: DataFrame, by: tuple[str, ...] = ("query_id",), score: str = "doc_score", key: str = "doc_id", rank: str = "doc_rank", cuts: list[float] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row within by: higher scores first, ties by the tie columns and then to the smaller key.

    Rows are ranked within steps of score, and within ranges of keys where the score is 0; the steps before give the
    offset. So no sort holds more than a step, whatever number of documents a query has. Scores of another scale than 0 to
    some tens need cuts of their own (cuts_of)."""
    step = F.floor(F.col(score) * STEPS).cast("long") if cuts is None else cell_of(F.col(score), cuts).cast("long")
    ids = F.when(F.col(score) == 0, F.shiftright(F.col(key).cast("long"), ID_BITS)).otherwise(F.lit(0).cast("long")) if not ties else F.lit(0).cast("long")
    placed = scores.withColumn("_step", step).withColumn("_ids", ids)
    cells = placed.groupBy(*by, "_step", "_ids").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(F.desc("_step"), "_ids").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_step", "_ids").orderBy(F.desc(score), *ties, key)
    out = placed.withColumn("_at", F.row_number().over(within)).join(cells, [*by, "_step", "_ids"])
    return out.withColumn(rank, (F.col("_before") + F.col("_at")).cast("long")).drop("_step", "_ids", "_before", "_at")
