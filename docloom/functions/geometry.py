"""Column expressions over boxes [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes that only touch have none."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(both == 0, 0.0).otherwise(both / union)


def side(boxes: Column, i: int) -> Column:
    """The i-th number of each box or point."""
    return F.transform(boxes, lambda b: b[i])


def union_box(boxes: Column) -> Column:
    """The box around an array of boxes; null if there are none."""
    sides = [agg(side(boxes, i)) for i, agg in enumerate((F.array_min, F.array_min, F.array_max, F.array_max))]
    return F.when(F.size(boxes) > 0, F.array(*sides))


def polygon_box(points: Column) -> Column:
    """The upright box around an array of [x, y] points."""
    xs, ys = (side(points, i).cast("array<double>") for i in (0, 1))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def through_homography(box: Column, h: Column) -> Column:
    """The upright box around the four corners after a 3 x 3 homography given as nine numbers."""

    def corner(x: Column, y: Column) -> Column:
        w = h[6] * x + h[7] * y + h[8]
        return F.array((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w)

    return polygon_box(F.array(*(corner(box[i], box[j]) for i in (0, 2) for j in (1, 3))))
