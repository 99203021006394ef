"""Page geometry for rendering: resolution limits and tile grids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RasterLimits:
    max_pixels: int
    tile_size: int


def raster_limits(ram_gb: float) -> RasterLimits:
    """Limits by memory. Fixed values."""
    if ram_gb >= 32:
        return RasterLimits(1_800_000, 1200)
    return RasterLimits(200_000, 400) if ram_gb >= 16 else RasterLimits(400_000, 600)


def safe_dpi(width: Column, height: Column, max_pixels: Column | int, max_side: Column | int, base_dpi: int = 150) -> Column:
    """Resolution at which a page (in points) stays under a number of pixels and a side length; at least 72, and
    96 for a page without extent."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    w, h = width.cast("double") * (base_dpi / 72.0), height.cast("double") * (base_dpi / 72.0)
    area, side = w * h, lit(max_side).cast("double")
    scale = F.when(area > lit(max_pixels), F.sqrt(lit(max_pixels) / area)).otherwise(F.lit(1.0))
    scale = F.when(w * scale > side, scale * (side / (w * scale))).otherwise(scale)
    scale = F.when(h * scale > side, scale * (side / (h * scale))).otherwise(scale)
    return F.when((width == 0) | (height == 0), F.lit(96)).otherwise(F.greatest(F.lit(72), (F.lit(float(base_dpi)) * scale).cast("int")))


def tiles(width: Column, height: Column, dpi: Column, tile_px: int, overlap: int) -> Column:
    """Array of tiles (iy, ix, x0, y0, x1, y1; in points) that cover a page row by row. Inner edges overlap."""
    s = dpi / F.lit(72.0)
    nx = F.greatest(F.lit(1), F.ceil(F.floor(width * s) / tile_px)).cast("int")
    ny = F.greatest(F.lit(1), F.ceil(F.floor(height * s) / tile_px)).cast("int")
    tile, over = F.lit(float(tile_px)) / s, F.lit(float(overlap)) / s

    def low(i: Column) -> Column:
        return i * tile - F.when(i > 0, over).otherwise(F.lit(0.0))

    def high(i: Column, n: Column, size: Column) -> Column:
        return F.least((i + 1) * tile + F.when(i + 1 < n, over).otherwise(F.lit(0.0)), size.cast("double"))

    def row(iy: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), nx - 1),
            lambda ix: F.struct(iy.alias("iy"), ix.alias("ix"), low(ix).alias("x0"), low(iy).alias("y0"), high(ix, nx, width).alias("x1"), high(iy, ny, height).alias("y1")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), ny - 1), row))
