import math

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import geometry, scores
from lumenseek.functions import text as tx


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first().out


@pytest.mark.parametrize(("given", "want"), [("  Sample   text   with   spaces  ", "Sample text with spaces"), ("   ", ""), ("", ""), ("a\x1c 　b\n", "a b")])
def test_clean_text(spark, given, want):
    assert one(spark, tx.clean_text(F.col("t")), t=given) == want


def python_usable(text):
    text = text.strip()
    if len(text) <= 20:
        return False
    words = text.split()
    if len(words) >= 50 and sum(len(w) == 1 for w in words) / len(words) > 0.6:
        return False
    return not (len({c for c in text if c.isalpha()}) <= 4 and len(text) > 100)


def test_text_usable(spark):
    cases = ["", "short", "x" * 21, " ".join("abcdefghij" * 6), "eeee " * 30, "a b c d " * 20 + "long words here " * 20, "1 2 3 4 " * 20, "The quick brown fox jumps over it. " * 4, "e1 " * 60]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", tx.text_usable(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: python_usable(c) for i, c in enumerate(cases)}
    assert one(spark, tx.text_usable(F.col("t").cast("string")), t=None) is False


def test_names_and_types(spark):
    paths = ["/a/b/Doc.PDF", "c\\d\\x.tar.gz", "noext", "/a.b/.hidden", "e/f.", "UP.HTM"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(tx.basename(F.col("p")), tx.extension(F.col("p")), tx.file_type(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("Doc.PDF", ".pdf", "pdf"), ("x.tar.gz", ".gz", "gz"), ("noext", "", "unknown"), (".hidden", "", "unknown"), ("f.", ".", "unknown"), ("UP.HTM", ".htm", "htm")]


def test_expansions(spark):
    answer = "1. first variant\n- second one\n\n•  3) third\n* no\n   fourth variant  \nfifth variant"
    assert one(spark, tx.parse_expansions(F.col("t"), 3), t=answer) == ["first variant", "second one", ") third"]


def test_skip_category(spark):
    for given, want in [("unsupported file type: .x", "incompatible file type"), ("file type not in filter: .y", "filtered file type"), ("file in hard-coded skip list.", "file in hard-coded skip list"), ("already processed", "already processed")]:
        assert one(spark, tx.skip_category(F.col("t")), t=given) == want


def test_extension_lists():
    supported = {".pdf", ".png"}
    assert tx.parse_extensions(" PDF, .png,, ", supported) == supported
    assert tx.parse_extensions("  ", supported) is None and tx.parse_extensions(None, supported) is None
    with pytest.raises(ValueError, match="docx"):
        tx.parse_extensions("pdf,docx", supported)
    assert tx.normalize_url("http://h:1//") == "http://h:1"


def python_alpha(query, base):
    n = len(query.split())
    clamp = lambda x: max(0.0, min(1.0, x))
    if not n:
        return clamp(base)
    low, high = max(0.1, min(1.0, base - 0.25)), clamp(base + 0.15)
    return low if n <= 3 else high if n >= 12 else low + (high - low) * (n - 3) / 9


@pytest.mark.parametrize("base", [0.0, 0.3, 0.65, 0.7, 0.95])
def test_dynamic_alpha(spark, base):
    cases = ["   ", "tax incentives", "one two three", "one two three four", "w " * 8, "w " * 12, "w " * 30]
    rows = spark.createDataFrame([(c,) for c in cases], "q string").select(scores.dynamic_alpha(F.col("q"), base).alias("a")).collect()
    assert [r.a for r in rows] == pytest.approx([python_alpha(c, base) for c in cases])


def test_vectors_and_fusion(spark):
    assert one(spark, scores.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    unit = one(spark, scores.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert unit == pytest.approx([0.6, 0.8])
    assert one(spark, scores.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert [one(spark, scores.dense_rescale(F.col("s")), s=s) for s in (0.2, 0.5, 0.75, 1.2)] == [0.0, 0.0, 0.5, 1.0]
    assert one(spark, scores.fuse(F.lit(0.6), F.lit(0.75), F.lit(1.0))) == pytest.approx(0.7)
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (3, 1.0), (3, 1.0)], "q int, s double")
    got = rows.select("q", scores.minmax(F.col("s"), "q").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (3, 1.0), (3, 1.0)]


def python_dpi(w, h, pixels, side, base):
    if w == 0 or h == 0:
        return 96
    a, b, s = w * base / 72, h * base / 72, 1.0
    if a * b > pixels:
        s = math.sqrt(pixels / (a * b))
    for x in (a, b):
        if x * s > side:
            s *= side / (x * s)
    return max(72, int(base * s))


@pytest.mark.parametrize(("w", "h", "pixels", "side", "base"), [(612, 792, 1_000_000, 10_000, 300), (720, 720, 10**9, 800, 300), (2880, 2880, 10**9, 400, 200), (0, 5, 1, 1, 150), (100, 2000, 200_000, 1500, 150)])
def test_safe_dpi(spark, w, h, pixels, side, base):
    got = one(spark, geometry.safe_dpi(F.lit(float(w)), F.lit(float(h)), pixels, side, base))
    assert abs(got - python_dpi(w, h, pixels, side, base)) <= 1
    if side == 800:
        assert 79 <= got <= 81


def test_tiles_cover_the_page(spark):
    grid = one(spark, geometry.tiles(F.lit(612.0), F.lit(792.0), F.lit(150), 400, 40))
    assert {(t.iy, t.ix) for t in grid} == {(y, x) for y in range(5) for x in range(4)}
    assert min(t.x0 for t in grid) == 0 and max(t.x1 for t in grid) == 612 and max(t.y1 for t in grid) == 792
    a, b = grid[0], grid[1]
    assert a.x1 > b.x0


def test_raster_limits():
    assert [geometry.raster_limits(g).tile_size for g in (8, 16, 32)] == [600, 400, 1200]
