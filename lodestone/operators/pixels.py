"""Images as a pixel relation (image, x, y, r, g, b, a): transforms are projections, filters and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RGBA = ["r", "g", "b", "a"]
KEY = "image"


def grid(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """df with one row a place (x, y) of a width x height raster."""
    return df.select("*", F.explode(F.sequence(F.lit(0), height - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), width - 1)).alias("x"))


def create(spark: SparkSession, images: int, width: int, height: int, pattern: str = "gradient") -> DataFrame:
    """Generated rasters (sides 1 to 2048): gradient, checker or plasma."""
    width, height = (max(1, min(2048, v)) for v in (width, height))
    at = spark.range(images * width * height)
    place = at.select(
        F.expr(f"id div {width * height}").alias(KEY), F.expr(f"id % {width}").cast("int").alias("x"), F.expr(f"id div {width} % {height}").cast("int").alias("y")
    )
    x, y = F.col("x"), F.col("y")
    v = F.sin(x / 8.0) + F.sin(y / 8.0) + F.sin((x + y) / 12.0)
    wave = lambda shift: (127 + 127 * F.sin(v + shift)).cast("int")
    on = (F.floor(x / 16) + F.floor(y / 16)) % 2 == 0
    colours = {
        "gradient": (F.expr(f"x * 255 div {max(1, width - 1)}"), F.expr(f"y * 255 div {max(1, height - 1)}"), F.lit(160)),
        "checker": tuple(F.when(on, dark).otherwise(light) for dark, light in ((0x20, 0xE8), (0x60, 0xE8), (0xC0, 0xF0))),
        "plasma": (wave(0), wave(2), wave(4)),
    }
    r, g, b = colours[pattern]
    return place.select(KEY, "x", "y", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), F.lit(255).alias("a"))


def crop(px: DataFrame, x: int, y: int, width: int, height: int, image_width: int, image_height: int) -> DataFrame:
    """The rectangle clamped into the image; its corner becomes the origin."""
    x, y = (max(0, min(v, m - 1)) for v, m in ((x, image_width), (y, image_height)))
    width, height = max(1, min(width, image_width - x)), max(1, min(height, image_height - y))
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return px.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def rotate(px: DataFrame, degrees: int, image_width: int, image_height: int) -> DataFrame:
    """Clockwise by 90, 180 or 270 degrees; anything else is refused."""
    x, y = F.col("x"), F.col("y")
    turned = {90: (image_height - 1 - y, x), 180: (image_width - 1 - x, image_height - 1 - y), 270: (y, image_width - 1 - x)}
    if degrees % 360 not in turned:
        raise ValueError("rotation must be 90, 180 or 270 degrees")
    new_x, new_y = turned[degrees % 360]
    return px.withColumns({"x": new_x, "y": new_y})


def flip(px: DataFrame, axis: str, image_width: int, image_height: int) -> DataFrame:
    """'vertical' mirrors top and bottom, anything else left and right."""
    if axis == "vertical":
        return px.withColumn("y", image_height - 1 - F.col("y"))
    return px.withColumn("x", image_width - 1 - F.col("x"))


def grayscale(px: DataFrame) -> DataFrame:
    grey = F.expr("(r * 299 + g * 587 + b * 114) div 1000").cast("int")
    return px.withColumns({"r": grey, "g": grey, "b": grey})


def _clamped(size: int) -> int:
    return max(1, min(8192, size))


def resize_nearest(px: DataFrame, image_width: int, image_height: int, width: int, height: int) -> DataFrame:
    """Each target place takes one source pixel; seen from the source, a pixel fills the targets between two bounds, so nothing is joined."""
    width, height = _clamped(width), _clamped(height)

    def targets(name: str, side: int, source: int) -> Column:
        # t * source div side = s  <=>  ceil(s * side / source) <= t < ceil((s + 1) * side / source)
        low = F.expr(f"({name} * {side} + {source - 1}) div {source}").cast("int")
        high = F.expr(f"(({name} + 1) * {side} + {source - 1}) div {source}").cast("int")
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    spread = px.select(KEY, F.explode(targets("y", height, image_height)).alias("ty"), "x", *RGBA)
    return spread.select(KEY, F.explode(targets("x", width, image_width)).alias("x"), F.col("ty").alias("y"), *RGBA)


def resize_bilinear(px: DataFrame, images: DataFrame, image_width: int, image_height: int, width: int, height: int) -> DataFrame:
    """Each target place mixes the four source pixels around it: four contributions a place, summed by place.

    images: one row an image (KEY). Scales map the corners onto each other; values are rounded half up.
    """
    width, height = _clamped(width), _clamped(height)
    scale = lambda source, target: (source - 1) / (target - 1) if target > 1 else 0.0
    places = grid(images.select(KEY), F.lit(width), F.lit(height))
    fx, fy = F.col("x") * F.lit(scale(image_width, width)), F.col("y") * F.lit(scale(image_height, height))
    x0, y0 = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(image_width - 1)), F.least(y0 + 1, F.lit(image_height - 1))
    wx, wy = fx - x0, fy - y0
    corners = F.array(
        *(F.struct(cx.alias("sx"), cy.alias("sy"), w.alias("w")) for cx, cy, w in ((x0, y0, (1 - wx) * (1 - wy)), (x1, y0, wx * (1 - wy)), (x0, y1, (1 - wx) * wy), (x1, y1, wx * wy)))
    )
    asked = places.select(KEY, "x", "y", F.explode(corners).alias("c")).select(KEY, F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("c.sx").alias("x"), F.col("c.sy").alias("y"), "c.w")
    mixed = asked.filter("w > 0").join(px, [KEY, "x", "y"])
    return mixed.groupBy(KEY, F.col("tx").alias("x"), F.col("ty").alias("y")).agg(*(F.floor(F.round(F.sum(F.col(c) * F.col("w")), 6) + 0.5).cast("int").alias(c) for c in RGBA))


def set_pixel(px: DataFrame, x: int, y: int, r: int, g: int, b: int, a: int = 255) -> DataFrame:
    """The raster with one pixel overwritten."""
    here = (F.col("x") == x) & (F.col("y") == y)
    return px.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in zip(RGBA, (r, g, b, a))})
