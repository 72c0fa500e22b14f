"""Box and coordinate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import fixed


def clip(v: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, hi))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def xyxy_to_centre(x1, y1, x2, y2, width, height) -> list[Column]:
    """Clip to the image, then centre-normalise; zeros for an image without size."""
    x1, x2 = clip(x1, width), clip(x2, width)
    y1, y2 = clip(y1, height), clip(y2, height)
    bw, bh = F.greatest(F.lit(0.0), x2 - x1), F.greatest(F.lit(0.0), y2 - y1)
    sized = (width > 0) & (height > 0)
    return [
        F.when(sized, v).otherwise(F.lit(0.0))
        for v in ((x1 + bw / 2) / width, (y1 + bh / 2) / height, bw / width, bh / height)
    ]


def centre_to_xyxy(cx, cy, w, h, width, height) -> list[Column]:
    """Centre-normalised box to clipped pixel corners."""
    return [
        clip((cx - w / 2) * width, width),
        clip((cy - h / 2) * height, height),
        clip((cx + w / 2) * width, width),
        clip((cy + h / 2) * height, height),
    ]


def box_text(box: list[Column], sep: str = ",", decimals: int = 2) -> Column:
    return F.concat(F.lit("["), F.concat_ws(sep, *[fixed(c, decimals) for c in box]), F.lit("]"))


def label_line(class_id: Column, box: list[Column], decimals: int = 5) -> Column:
    """One line of a label file: class id and centre-normalised box."""
    return F.concat_ws(" ", class_id.cast("string"), *[fixed(c, decimals) for c in box])


def crop_fixed(x1, y1, x2, y2, width, height, pad: int = 20) -> list[Column]:
    """Truncate, pad by a fixed number of pixels, clip to the image."""
    lo = [F.greatest(F.lit(0), v.cast("int") - pad) for v in (x1, y1)]
    return lo + [F.least(width, x2.cast("int") + pad), F.least(height, y2.cast("int") + pad)]


def crop_ratio(x1, y1, x2, y2, width, height, ratio: float = 0.2) -> list[Column]:
    """Pad by a share of the box size, at least one pixel, clip to the image."""
    px = F.greatest(F.lit(1), ((x2 - x1) * ratio).cast("int"))
    py = F.greatest(F.lit(1), ((y2 - y1) * ratio).cast("int"))
    return [
        F.greatest(F.lit(0), x1 - px),
        F.greatest(F.lit(0), y1 - py),
        F.least(width, x2 + px),
        F.least(height, y2 + py),
    ]


def into_crop(x, y, box: list[Column]) -> tuple[Column, Column, Column]:
    """Click in crop coordinates, and whether it lies inside the crop."""
    px, py = x - box[0], y - box[1]
    inside = (px >= 0) & (py >= 0) & (px < box[2] - box[0]) & (py < box[3] - box[1])
    return px.cast("int"), py.cast("int"), inside


def to_thousand(v: Column, size: Column) -> Column:
    """Pixel to the 0..1000 scale, truncated."""
    return (v / size * 1000).cast("int")


def from_thousand(v: Column, size: Column) -> Column:
    """0..1000 scale back to a pixel, truncated and clamped to the image."""
    return F.greatest(F.lit(0), F.least((v / 1000 * size).cast("int"), size - 1))
