"""Page geometry as columns. A page has media_width, media_height, rotation (0-3 quarter turns) and crop_* bounds or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


def unrotated_width() -> Column:
    return F.coalesce(F.abs(_c("crop_right") - _c("crop_left")), _c("media_width"))


def unrotated_height() -> Column:
    return F.coalesce(F.abs(_c("crop_bottom") - _c("crop_top")), _c("media_height"))


def render_size() -> tuple[Column, Column]:
    turned = _c("rotation").isin(1, 3)
    w, h = unrotated_width(), unrotated_height()
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def flip_y(height: Column, y: Column) -> Column:
    return height - y


def pdf_to_stored(x: Column, y: Column) -> tuple[Column, Column]:
    return x - F.coalesce(_c("crop_left"), F.lit(0.0)), F.coalesce(_c("crop_top"), unrotated_height()) - y


def stored_to_pdf(x: Column, y: Column) -> tuple[Column, Column]:
    """Ignores the crop offset, so it is the inverse of pdf_to_stored only without a crop box."""
    return x, unrotated_height() - y


def stored_to_render(x: Column, y: Column) -> tuple[Column, Column]:
    w, h, turn = unrotated_width(), unrotated_height(), _c("rotation")
    up = h - y
    rx = F.when(turn == 1, up).when(turn == 2, w - x).when(turn == 3, h - up).otherwise(x)
    ry = F.when(turn == 1, w - x).when(turn == 2, h - up).when(turn == 3, x).otherwise(h - up)
    return rx, ry


def box_to_render(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> tuple[Column, Column, Column, Column]:
    (ax, ay), (bx, by) = stored_to_render(x_min, y_min), stored_to_render(x_max, y_max)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def to_layout(x: Column, y: Column, page_w: Column, page_h: Column, width: float, height: float) -> tuple[Column, Column]:
    return x * (F.lit(width) / page_w), (page_h - y) * (F.lit(height) / page_h)


def layout_size(w: Column, h: Column, page_w: Column, page_h: Column, width: float, height: float) -> tuple[Column, Column]:
    """Boxes are never drawn smaller than 8 units."""
    return F.greatest(F.lit(8.0), w * (F.lit(width) / page_w)), F.greatest(F.lit(8.0), h * (F.lit(height) / page_h))


def centre_y(cx: Column, cy: Column, page_h: Column, rotation: Column) -> Column:
    """Height of a box's centre on the rendered page, from 0 to 1."""
    y = F.when(rotation == 1, page_h - cx).when(rotation == 3, cx).otherwise(cy)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), y / page_h))
