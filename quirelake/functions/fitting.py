"""Text that shrinks until it fits a box, as column functions.

A box has lines, an array of structs (chars, level, kind); kind is text, bullet, code or display.
All lengths are in points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font sizes of text, of text at least, of code and of tables; the least scale and how often it is corrected; space after a
# line of text, height of a line in its size, indentation of a level, margins of a table cell; width of a letter in its size.
BODY_SIZE, LEAST_SIZE, CODE_SIZE, TABLE_SIZE = 20.0, 12.0, 16.0, 14.0
LEAST_SCALE, STEPS = 0.5, 5
SPACE_AFTER, LINE_HEIGHT, INDENT, MARGIN = 6.0, 1.2, 27.0, 14.4
LETTER, CODE_LETTER = 0.5, 0.6
# The least size of a title, the step by which it shrinks, and the width of its letters.
TITLE_LEAST, TITLE_STEP, TITLE_LETTER = 18.0, 2.0, 0.55


def wrapped(chars: Column, size: Column, width: Column, letter: Column | float) -> Column:
    """Lines that so many characters take in a width, one at least."""
    return F.greatest(F.lit(1.0), F.ceil(chars / F.greatest(F.lit(1.0), width / (size * letter))).cast("double"))


def lines_height(lines: Column, width: Column, scale: Column) -> Column:
    """The height that lines take at a scale."""

    def height(line: Column) -> Column:
        code, display = line["kind"] == "code", line["kind"] == "display"
        size = F.when(code, CODE_SIZE).otherwise(F.greatest(F.lit(LEAST_SIZE), BODY_SIZE - 2.0 * line["level"])) * scale
        indent = F.when(line["kind"] == "bullet", (line["level"] + 1) * INDENT).otherwise(0.0)
        count = F.when(display, 2.0).otherwise(wrapped(line["chars"], size, width - indent, F.when(code, CODE_LETTER).otherwise(LETTER)))
        return count * size * LINE_HEIGHT + F.when(code, 0.0).otherwise(SPACE_AFTER * scale)

    return F.aggregate(lines, F.lit(0.0), lambda total, line: total + height(line))


def cell_height(chars: Column, width: Column, scale: Column) -> Column:
    """The height of a table cell, margins included."""
    size = TABLE_SIZE * scale
    return wrapped(chars, size, width - MARGIN, LETTER) * size * LINE_HEIGHT + MARGIN


def fitted_scale(lines: Column, width: Column, available: Column, start: float = 1.0) -> Column:
    """The scale at which lines fit a box: corrected at most ``STEPS`` times by what is too much, never below ``LEAST_SCALE``.

    The steps are a fold, so the expression of a step stands in the plan once.
    """

    def step(scale: Column, _: Column) -> Column:
        height = lines_height(lines, width, scale)
        return F.when((height <= available) | (scale <= LEAST_SCALE), scale).otherwise(F.greatest(F.lit(LEAST_SCALE), scale * available / height))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(float(start)), step)


def title_size(chars: Column, width: Column, start: float) -> Column:
    """The size of a title of two lines at most: the first of ``start``, two less and so on that fits, or the least.

    What fits is chars * size <= 2 * width / letter, so the number of steps has a closed form.
    """
    over = F.lit(start) - 2 * (width / TITLE_LETTER) / F.greatest(chars, F.lit(1))
    steps = F.greatest(F.lit(0.0), F.ceil(over / TITLE_STEP).cast("double"))
    most = max(0.0, -(-(start - TITLE_LEAST) // TITLE_STEP))
    return F.lit(start) - TITLE_STEP * F.least(steps, F.lit(most))
