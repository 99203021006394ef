from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from lumenseek.functions.geometry import tiles
from lumenseek.sources.ocr import Recognizer, tile_clips


@dataclass
class Image:
    width: int
    height: int

    def resized(self, w, h):
        return Image(w, h)


class Engine:
    def __init__(self, fails=()):
        self.seen, self.fails = [], list(fails)

    def read(self, image):
        self.seen.append((image.width, image.height))
        if self.fails and (error := self.fails.pop(0)):
            raise error
        return ["line", f"{image.width}x{image.height}"]


class Page:
    width, height = 1200, 1000

    def render(self, dpi, clip):
        return Image(1, 1) if clip is None else Image(round(clip[2] - clip[0]), round(clip[3] - clip[1]))

    def images(self):
        return [Image(50, 500), Image(120, 130)]


def test_image_guards():
    assert Recognizer(Engine()).image(Image(99, 4000)) == ""
    engine = Engine()
    Recognizer(engine).image(Image(1024, 1024))
    assert engine.seen == [(256, 256)]
    engine = Engine([MemoryError()])
    assert Recognizer(engine).image(Image(200, 200)) == "line\n128x128" and engine.seen[-1] == (128, 128)
    assert Recognizer(Engine([RuntimeError()])).image(Image(200, 200)) == ""
    assert Recognizer(Engine([MemoryError(), MemoryError()])).image(Image(200, 200)) == ""


def test_embedded_images():
    assert Recognizer(Engine()).embedded(Page()) == "line\n120x130"


def test_pages_by_tiles():
    assert Recognizer(Engine(), tile_px=2000).page(Page(), 72) == "line\n1x1"
    engine = Engine()
    Recognizer(engine, tile_px=600).page(Page(), 72)
    assert len(engine.seen) == 4
    engine = Engine([MemoryError()])
    Recognizer(engine, tile_px=1000).page(Page(), 72)
    assert len(engine.seen) == 1 + 6
    engine = Engine([None, ValueError()])
    assert Recognizer(engine, tile_px=600).page(Page(), 72).count("line") == 3


@pytest.mark.parametrize(("w", "h", "dpi", "px", "over"), [(612, 792, 150, 400, 40), (100, 100, 72, 400, 40), (1000, 300, 96, 256, 0)])
def test_clips_equal_columns(spark, w, h, dpi, px, over):
    got = spark.range(1).select(tiles(F.lit(float(w)), F.lit(float(h)), F.lit(dpi), px, over).alias("t")).first().t
    assert [pytest.approx((t.x0, t.y0, t.x1, t.y1)) for t in got] == tile_clips(w, h, dpi, px, over)
