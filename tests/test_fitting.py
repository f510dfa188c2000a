"""Shrinking against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from quirelake.functions import fitting


def _height(lines, width, scale):
    total = 0.0
    for chars, level, kind in lines:
        size = (16.0 if kind == "code" else max(12.0, 20.0 - 2 * level)) * scale
        indent = (level + 1) * 27.0 if kind == "bullet" else 0
        per = max(1.0, (width - indent) / (size * (0.6 if kind == "code" else 0.5)))
        total += (2 if kind == "display" else max(1, math.ceil(chars / per))) * size * 1.2 + (0 if kind == "code" else 6.0 * scale)
    return total


def test_scales_and_titles(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lines = [(rng.randrange(0, 400), rng.randrange(0, 5), rng.choice(["text", "bullet", "code", "display"])) for _ in range(rng.randrange(0, 15))]
        rows.append((i, lines, float(rng.choice([40, 200, 600])), float(rng.choice([30, 150, 400])), rng.randrange(0, 300)))
    df = spark.createDataFrame(rows, "i int, lines array<struct<chars: int, level: int, kind: string>>, width double, available double, chars int")
    got = df.select("i", fitting.fitted_scale(F.col("lines"), F.col("width"), F.col("available")).alias("scale"), fitting.title_size(F.col("chars"), F.col("width"), 32.0).alias("title"), fitting.cell_height(F.col("chars"), F.col("width"), F.lit(0.75)).alias("cell")).orderBy("i").collect()
    for (_, lines, width, available, chars), r in zip(rows, got, strict=True):
        scale = 1.0
        for _ in range(5):
            height = _height(lines, width, scale)
            if height <= available or scale <= 0.5:
                break
            scale = max(0.5, scale * available / height)
        size = 32.0
        while size > 18.0 and chars * size > 2 * (width / 0.55):
            size -= 2
        assert r.scale == pytest.approx(scale, rel=1e-12) and r.title == size
        assert r.cell == pytest.approx(max(1, math.ceil(chars / max(1.0, (width - 14.4) / (10.5 * 0.5)))) * 10.5 * 1.2 + 14.4)
