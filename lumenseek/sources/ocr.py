"""Recognition of images and rendered pages, around an engine that reads one image.

An engine has ``read(image) -> list[str]`` (lines). Images have ``width``, ``height`` and ``resized(w, h)``;
pages have ``width``, ``height`` (points), ``render(dpi, clip) -> image`` and ``images() -> list[image]``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

#: Images with a shorter side have nothing to read; larger areas are scaled down first; what then still exceeds
#: memory is tried once more at this side. Fixed values.
LEAST_SIDE, LARGEST_AREA, SMALL_SIDE = 100, 65_536, 128
#: Tiles larger than this are halved once if one fails.
HALVED_FROM = 800


@dataclass
class Recognizer:
    engine: Any
    tile_px: int = 600
    overlap: int = 40

    def lines(self, image: Any) -> str:
        return "\n".join(self.engine.read(image))

    def image(self, image: Any) -> str:
        """Text of a single image; "" if it is too small or can't be read."""
        if min(image.width, image.height) < LEAST_SIDE:
            return ""
        area = image.width * image.height
        if area > LARGEST_AREA:
            scale = math.sqrt(LARGEST_AREA / area)
            image = image.resized(max(1, int(image.width * scale)), max(1, int(image.height * scale)))
        try:
            return self.lines(image)
        except MemoryError:
            try:
                return self.lines(image.resized(SMALL_SIDE, SMALL_SIDE))
            except (MemoryError, RuntimeError):
                return ""
        except (OSError, RuntimeError, ValueError):
            return ""

    def embedded(self, page: Any) -> str:
        """Text of a page's images, those without any left out."""
        return "\n".join(t for t in (self.image(i) for i in page.images()) if t.strip())

    def page(self, page: Any, dpi: int) -> str:
        """Text of a rendered page: whole if it fits a tile, else tile by tile."""
        if max(page.width, page.height) * dpi / 72 <= self.tile_px:
            return self.lines(page.render(dpi, None))
        return self._tiled(page, dpi, self.tile_px, True)

    def _tiled(self, page: Any, dpi: int, tile_px: int, may_halve: bool) -> str:
        out = []
        for clip in tile_clips(page.width, page.height, dpi, tile_px, self.overlap):
            try:
                text = self.lines(page.render(dpi, clip))
            except (MemoryError, RuntimeError):
                if may_halve and tile_px > HALVED_FROM:
                    return self._tiled(page, dpi, tile_px // 2, False)
                continue
            except (OSError, ValueError):
                continue
            if text.strip():
                out.append(text)
        return "\n".join(out)


def tile_clips(width: float, height: float, dpi: int, tile_px: int, overlap: int) -> list[tuple[float, float, float, float]]:
    """Tiles row by row as (x0, y0, x1, y1) in points; :func:`functions.geometry.tiles` for one page."""
    s = dpi / 72.0
    nx, ny = (max(1, math.ceil(int(side * s) / tile_px)) for side in (width, height))
    tile, over = tile_px / s, overlap / s
    low = lambda i: i * tile - over * (i > 0)
    high = lambda i, n, size: min((i + 1) * tile + over * (i + 1 < n), size)
    return [(low(x), low(y), high(x, nx, width), high(y, ny, height)) for y in range(ny) for x in range(nx)]


def page_dpi(width: float, height: float, max_pixels: int, max_side: int, base_dpi: int) -> int:
    """:func:`functions.geometry.safe_dpi` for one page."""
    w, h = width * (base_dpi / 72.0), height * (base_dpi / 72.0)
    if not width or not height:
        return 96
    scale = math.sqrt(max_pixels / (w * h)) if w * h > max_pixels else 1.0
    for side in (w, h):
        if side * scale > max_side:
            scale *= max_side / (side * scale)
    return max(72, int(base_dpi * scale))


@dataclass
class OcrExtractor:
    """A text extractor (:class:`providers.TextExtractor`) around a PDF reader and a recogniser.

    ``open_pdf`` gives a document's pages, which beside what a recogniser needs have ``text() -> str`` and
    ``has_form() -> bool``; ``open_image`` gives an image. Nothing is rendered for a page whose text layer serves.
    """

    recognizer: Recognizer
    open_pdf: Callable[[bytes], Iterable[Any]]
    open_image: Callable[[bytes], Any]
    base_dpi: int = 150
    max_pixels: int = 400_000
    max_side: int = 2000

    def pages(self, content: bytes) -> Iterator[tuple[str, Callable[[], str], Callable[[], str]]]:
        return self._each(self.open_pdf(content))

    def page_range(self, content: bytes, first: int, count: int) -> Iterator[tuple[str, Callable[[], str], Callable[[], str]]]:
        """As :meth:`pages`, of ``count`` pages from ``first`` on."""
        return self._each(itertools.islice(self.open_pdf(content), first, first + count))

    def _each(self, pages: Iterable[Any]) -> Iterator[tuple[str, Callable[[], str], Callable[[], str]]]:
        for page in pages:
            dpi = page_dpi(page.width, page.height, self.max_pixels, self.max_side, self.base_dpi)
            yield page.text(), lambda p=page: self.recognizer.embedded(p), lambda p=page, d=dpi: self.recognizer.page(p, d)

    def image(self, content: bytes) -> str:
        return self.recognizer.image(self.open_image(content))

    def inspect(self, content: bytes) -> tuple[int, bool]:
        """Pages, and whether any has interactive fields."""
        pages = list(self.open_pdf(content))
        return len(pages), any(p.has_form() for p in pages)
