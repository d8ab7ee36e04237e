"""Axis-aligned boxes with corners in 0..1."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ["x0", "y0", "x1", "y1"]


def normalize(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct of sorted corners in 0..1; the scale (1, 100 or 1000) follows from the largest corner."""
    top = F.greatest(*(F.abs(x) for x in (x0, y0, x1, y1)))
    scale = F.when(top <= 1.5, 1.0).when(top <= 100, 100.0).otherwise(1000.0)
    clamp = lambda x: F.least(F.greatest(x / scale, F.lit(0.0)), F.lit(1.0))
    return F.struct(clamp(F.least(x0, x1)).alias("x0"), clamp(F.least(y0, y1)).alias("y0"), clamp(F.greatest(x0, x1)).alias("x1"), clamp(F.greatest(y0, y1)).alias("y1"))


def area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with the column prefixes ``a`` and ``b``; 0 for empty ones."""
    w = F.greatest(F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0")), F.lit(0.0))
    h = F.greatest(F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0")), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def cells(boxes: DataFrame, size: float, only_centre: bool = False) -> DataFrame:
    """Boxes with the grid cells (``cx``, ``cy``) that they touch, or that their centre lies in."""
    cell = lambda x: F.floor(x / size).cast("int")
    if only_centre:
        return boxes.withColumn("cx", cell((F.col("x0") + F.col("x1")) / 2)).withColumn("cy", cell((F.col("y0") + F.col("y1")) / 2))
    return boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))


def centre_join(outer: DataFrame, inner: DataFrame, page: list[str], size: float = 0.1) -> DataFrame:
    """Pairs (outer, inner) of one page whose inner centre lies in the outer box.

    ``outer``: page, ``outer_id``, corners; ``inner``: page, ``inner_id``, corners. Both sides are laid on a grid
    and joined by equality of page and cell; the box test only sees what shares a cell.
    """
    a = cells(outer.dropna(subset=CORNERS), size).select(*page, "cx", "cy", "outer_id", *(F.col(x).alias("a_" + x) for x in CORNERS))
    b = cells(inner.dropna(subset=CORNERS), size, only_centre=True).select(*page, "cx", "cy", "inner_id", *(F.col(x).alias("b_" + x) for x in CORNERS))
    mx, my = (F.col("b_x0") + F.col("b_x1")) / 2, (F.col("b_y0") + F.col("b_y1")) / 2
    inside = (mx >= F.col("a_x0")) & (mx <= F.col("a_x1")) & (my >= F.col("a_y0")) & (my <= F.col("a_y1"))
    return a.join(b, [*page, "cx", "cy"]).where(inside).drop("cx", "cy").distinct()


def overlapping(boxes: DataFrame, page: list[str], least: float, size: float = 0.1) -> DataFrame:
    """Pairs (id_1 < id_2) of one page with an IoU of at least ``least``, found by shared grid cells."""
    laid = cells(boxes.dropna(subset=CORNERS), size)
    a = laid.select(*page, "cx", "cy", F.col("box_id").alias("id_1"), *(F.col(x).alias("a_" + x) for x in CORNERS))
    b = laid.select(*page, "cx", "cy", F.col("box_id").alias("id_2"), *(F.col(x).alias("b_" + x) for x in CORNERS))
    return a.join(b, [*page, "cx", "cy"]).where("id_1 < id_2").where(iou("a_", "b_") >= least).select(*page, "id_1", "id_2", F.round(iou("a_", "b_"), 4).alias("iou")).distinct()


def merge_close(boxes: DataFrame, page: list[str], gap: float) -> DataFrame:
    """Boxes of a page merged while two are closer than ``gap``, until nothing changes.

    Boxes grow as they merge, so this is a fixpoint within one page; a page is one group (of at most some hundred
    boxes), the pages are spread by Spark. The first box (by id) gives the merged box its id.
    """

    def merge(frame):
        import pandas as pd

        todo = [list(r) for r in frame.sort_values("box_id")[["box_id", *CORNERS, "n"]].itertuples(index=False)]
        changed = True
        while changed:
            changed = False
            out = []
            for b in todo:
                for a in out:
                    if b[1] <= a[3] + gap and a[1] <= b[3] + gap and b[2] <= a[4] + gap and a[2] <= b[4] + gap:
                        a[1:6] = min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]
                        changed = True
                        break
                else:
                    out.append(b)
            todo = out
        result = pd.DataFrame(todo, columns=["box_id", *CORNERS, "n"])
        for x in reversed(page):
            result.insert(0, x, frame[x].iloc[0])
        return result

    rows = boxes.dropna(subset=CORNERS).select(*page, "box_id", *CORNERS, F.lit(1).alias("n"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.groupBy(*page).applyInPandas(merge, schema)


def dropped_greedily(pairs: DataFrame, page: list[str]) -> DataFrame:
    """(box_id): boxes that overlap an earlier box (by id) which is kept itself. ``pairs``: page, ``id_1`` < ``id_2``.

    Whether a box is kept depends on those before it, so the pairs of a page are one group; pages are spread by Spark.
    """

    def drop(group: pa.Table) -> pa.Table:
        gone: set = set()
        for a, b in sorted(zip(group["id_1"].to_pylist(), group["id_2"].to_pylist(), strict=True), key=lambda p: (p[1], p[0])):
            if a not in gone:
                gone.add(b)
        return pa.table({"box_id": pa.array(sorted(gone), group.schema.field("id_2").type)})

    rows = pairs.select(*page, "id_1", "id_2")
    return rows.groupBy(*page).applyInArrow(drop, f"box_id {dict(rows.dtypes)['id_2']}")


def halved(a: Column, b: Column, most: float, overlap: float) -> Column:
    """Parts (``a``, ``b``) of a span that is cut in halves with an overlap until none is longer than ``most``; in order.

    All parts of one depth are equally long, so the depth comes first and the parts follow from the bits of their number.
    """
    start = F.struct((b - a).alias("size"), F.lit(0).alias("depth"))
    longer = lambda s: F.when(s["size"] > most + 1e-9, F.struct(((s["size"] + overlap) / 2).alias("size"), (s["depth"] + 1).alias("depth"))).otherwise(s)
    depth = F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, lambda s, _: longer(s))["depth"]

    def part(k: Column) -> Column:
        def go(s: Column, j: Column) -> Column:
            size = (s["size"] + overlap) / 2
            bit = F.floor(k / F.pow(F.lit(2.0), depth - j)) % 2
            return F.struct((s["a"] + bit * (s["size"] - size)).alias("a"), size.alias("size"))

        done = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(20)), lambda j: j <= depth), F.struct(a.alias("a"), (b - a).alias("size")), go)
        return F.struct(done["a"].alias("a"), (done["a"] + done["size"]).alias("b"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), (F.pow(F.lit(2.0), depth) - 1).cast("bigint")), part)
