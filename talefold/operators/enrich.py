"""Section labels of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talefold.functions.text import is_blank

# Labels that a chunk may have.
TAGS = ["setup", "inciting_incident", "rising_action", "confrontation", "twist", "climax", "fallout", "resolution", "epilogue", "setting", "negotiation"]


def positional_tag(index: Column, total: Column) -> Column:
    """The label that a chunk's place in its story suggests."""
    return (
        F.when((total <= 1) | (index == 1), "setup")
        .when(index == 2, F.when(total >= 4, "inciting_incident").otherwise("rising_action"))
        .when(index >= total, "resolution")
        .when(index == total - 1, F.when(total >= 5, "climax").otherwise("confrontation"))
        .otherwise("rising_action")
    )


def labelled(chunks: DataFrame, by: str, order: str, label: str, tags: list[str] = TAGS, most: int = 3, skip: Column | None = None) -> DataFrame:
    """`section` of each chunk: its label, or its positional tag where the label is unknown or repeats itself more than `most` times.

    Place and total count all chunks; repetitions count among those that are
    not skipped. An empty label ends a run. Skipped rows keep their label.
    """
    whole = Window.partitionBy(by)
    rows = chunks.withColumn("_i", F.row_number().over(whole.orderBy(order))).withColumn("_n", F.count("*").over(whole)).withColumn("_skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    active = Window.partitionBy(by, "_skip").orderBy(order)
    now, before = F.coalesce(F.col(label), F.lit("")), F.lag(F.coalesce(F.col(label), F.lit(""))).over(active)
    rows = rows.withColumn("_change", F.when((now == before) & (now != ""), 0).otherwise(1)).withColumn("_run", F.sum("_change").over(active))
    rows = rows.withColumn("_streak", F.row_number().over(Window.partitionBy(by, "_skip", "_run").orderBy(order)) - 1)
    chosen = F.when(~F.col(label).isin(tags) | is_blank(F.col(label)) | (F.col("_streak") >= most), positional_tag(F.col("_i"), F.col("_n"))).otherwise(F.col(label))
    return rows.withColumn("section", F.when(F.col("_skip"), F.col(label)).otherwise(chosen)).drop("_i", "_n", "_skip", "_change", "_run", "_streak")
