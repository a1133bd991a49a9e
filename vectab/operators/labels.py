"""Labels on the map: boxes from text length, and which of them are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import greedy_rounds
from ..plans.scaling import salted_join
from .spatial import cell_of

CHAR_WIDTH = 7.0
LINE_HEIGHT = 14.0


def label_boxes(
    points: DataFrame, text_length: str, x: str = "x", y: str = "y",
    char_width: float = CHAR_WIDTH, line_height: float = LINE_HEIGHT,
) -> DataFrame:
    """Add the box of a label that starts at the point and runs to the right."""
    return (
        points.withColumn("min_x", F.col(x).cast("double"))
        .withColumn("max_x", F.col(x) + F.col(text_length) * F.lit(float(char_width)))
        .withColumn("min_y", F.col(y).cast("double"))
        .withColumn("max_y", F.col(y) + F.lit(float(line_height)))
    )


def declutter(boxes: DataFrame, pos: str) -> DataFrame:
    """The boxes shown when walked in ``pos`` order: one is shown if it meets no shown one.

    Touching counts as meeting. Grid cells are no larger than the smallest
    box, so boxes that start in the same cell always meet and a crowded spot
    costs one probe per round; other meetings are found in the covered cells.
    """
    least = boxes.agg(
        F.min(F.col("max_x") - F.col("min_x")).alias("w"), F.min(F.col("max_y") - F.col("min_y")).alias("h"),
        F.max(F.col("max_x") - F.col("min_x")).alias("tw"), F.max(F.col("max_y") - F.col("min_y")).alias("th"),
    ).first()
    # boxes without area still need cells; they only meet where they coincide
    wide = least.w or (least.tw or 1.0) / 16
    high = least.h or (least.th or 1.0) / 16
    cols = ["min_x", "min_y", "max_x", "max_y"]
    items = boxes.select(F.col(pos).alias("pos"), *cols).withColumn(
        "cx", cell_of("min_x", wide)).withColumn("cy", cell_of("min_y", high))
    has_area = bool(least.w) and bool(least.h)

    def covered(frame: DataFrame) -> DataFrame:
        return (
            frame.withColumn("gx", F.explode(F.sequence("cx", cell_of("max_x", wide))))
            .withColumn("gy", F.explode(F.sequence("cy", cell_of("max_y", high))))
        )

    def conflicts(probes: DataFrame, undecided: DataFrame) -> DataFrame:
        a = covered(probes).select(F.col("pos").alias("probe"), "gx", "gy", *[F.col(c).alias(f"p_{c}") for c in cols])
        b = covered(undecided).select("pos", "gx", "gy", *cols)
        c = F.col
        meet = (c("p_min_x") <= c("max_x")) & (c("min_x") <= c("p_max_x"))
        meet &= (c("p_min_y") <= c("max_y")) & (c("min_y") <= c("p_max_y"))
        # report a meeting once: in the cell of the common area's lower left corner
        once = (c("gx") == cell_of(F.greatest("p_min_x", "min_x"), wide)) & (
            c("gy") == cell_of(F.greatest("p_min_y", "min_y"), high))
        return salted_join(b, a, ["gx", "gy"], spread="pos").filter(meet & once).select("probe", "pos")

    shown = greedy_rounds(items, conflicts, ["cx", "cy"] if has_area else None)
    return boxes.join(shown.select(F.col("pos").alias(pos)), pos, "left_semi")
