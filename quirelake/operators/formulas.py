"""Formulas of sheets: references by offset, lines over ranges, and cells.

A formula is cut into tokens by one regular expression: texts in
quotes, quoted sheet names, structured references, function names and
names stay as they are; cells (``B2``, ``$A$1``), whole columns (``A:C``) and
whole rows (``2:5``) are references.  Two formulas are the same one, moved, iff
their *relative forms* are equal: each coordinate without ``$`` as its
distance from the formula's own cell, each with ``$`` as it stands.

So a range of cells that repeat one formula is an island of equal relative
forms, and writing a formula out over a range adds the offset to each free coordinate.
Forms and cells are worked out by a Python worker, once for each formula and place, or line, of a batch: higher-order
functions of Spark, which are interpreted, take many times as long.  Islands are found by two
passes over cells in the order that a window gives them, down columns and along rows; windows are partitioned by sheet and
column, or row; a range is written out by a generator, some cells at a time.

Defined results: null formulas are no cells; a formula that a shift would push off the sheet
stays as it is, and never joins a run; lines that are no ``range = formula`` are passed over; of several lines
over one cell the last counts; letters of references come out in upper case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.values import let

# The last row and column of a sheet, and what stands between the range and the formula of a line.
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384
SEPARATOR = " = "
#: What no formula holds: it marks the references of a relative form.
_MARK = "\x01"

_CELL = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}(?![\w(.!])"
_COLUMNS = r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(.$!])"
_ROWS = r"\$?[1-9][0-9]{0,6}:\$?[1-9][0-9]{0,6}(?![\w.$!])"
#: Kept as they are: texts, sheet names, structured references, numbers and names (functions, sheets, defined names).
_OTHER = r"\"(?:[^\"]|\"\")*+\"|'(?:[^']|'')*+'!?|\[[^\]]*+\]|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|[\w\\][\w.\\]*+[!(]?|[\s\S]"
TOKEN = f"{_CELL}|{_COLUMNS}|{_ROWS}|{_OTHER}"
_TOKEN = re.compile(f"({_CELL})|({_COLUMNS})|({_ROWS})|{_OTHER}", re.ASCII)
_REFERENCE = re.compile(r"(\$?)([A-Za-z]*)(\$?)([0-9]*)(?::(\$?)(\w+))?")
_FORM_REFERENCE = re.compile(f"{_MARK}([^{_MARK}]*){_MARK}")


def column_number(letters: Column) -> Column:
    """A is 1, AA is 27; letters of any case."""
    digits = F.transform(F.split(F.upper(letters), ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c) - 64))
    return F.aggregate(digits, F.lit(0), lambda n, d: F.when(d == 0, n).otherwise(n * 26 + d))


def column_letters(number: Column) -> Column:
    """1 is A, 27 is AA; null beyond three letters."""
    n = number.cast("long")
    letter = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    third = F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise("")
    second = F.when(n > 26, letter(F.floor((n - 27) / 26))).otherwise("")
    return F.when((n >= 1) & (n <= 26), letter(n - 1)).when((n >= 1) & (n <= 18_278), F.concat(third, second, letter(n - 1)))


def cell_name(row: Column, col: Column) -> Column:
    """The name of a cell; rows and columns count from 1."""
    return F.concat(column_letters(col), row.cast("string"))


@lru_cache(1024)
def _number(letters: str) -> int:
    n = 0
    for letter in letters.upper():
        n = 26 * n + ord(letter) - 64
    return n


@lru_cache(1024)
def _letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def form_of(formula: str, row: int, col: int) -> str:
    """The relative form of a formula in its cell: coordinates of references as ``kind:number``, kinds r and c free, R and C fixed."""

    def coordinate(fixed: str, value: str) -> str:
        is_row = value.isdigit()
        number = int(value) if is_row else _number(value)
        if fixed:
            return f"{'R' if is_row else 'C'}:{number}"
        return f"r:{number - row}" if is_row else f"c:{number - col}"

    def form(token: re.Match) -> str:
        if token.lastindex is None:
            return token[0]
        sign, letters, second, digits, third, last = _REFERENCE.match(token[0]).groups()
        if last:
            return f"{_MARK}{coordinate(sign or second, letters or digits)},{coordinate(third, last)}{_MARK}"
        return f"{_MARK}{coordinate(sign, letters)},{coordinate(second, digits)}{_MARK}"

    return _TOKEN.sub(form, formula)


def formula_at(form: str, row: int, col: int) -> str | None:
    """A relative form as the formula of a cell; null if a reference would leave the sheet."""
    inside = True

    def placed(part: str) -> str:
        nonlocal inside
        kind, number = part[0], int(part[2:])
        at = number + row if kind == "r" else number + col if kind == "c" else number
        is_row = kind in "rR"
        inside = inside and 1 <= at <= (LAST_ROW if is_row else LAST_COLUMN)
        return ("$" if kind in "RC" else "") + (str(at) if is_row else _letters(at)) if inside else ""

    def reference(found: re.Match) -> str:
        first, last = found[1].split(",")
        return placed(first) + (":" if first[0].lower() == last[0].lower() else "") + placed(last)

    formula = _FORM_REFERENCE.sub(reference, form)
    return formula if inside else None


def moved_text(formula: str, row: int, col: int, to_row: int, to_col: int) -> str:
    """The formula of cell (row, col) as it reads in another cell; unchanged where a reference would leave the sheet."""
    return formula_at(form_of(formula, row, col), to_row, to_col) or formula


def _each_once(work: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``work`` of the values of rows, a text and whole numbers, called once for equal ones; null where one is null."""
    keys = pc.binary_join_element_wise(*(c.cast(pa.string()) for c in columns), _MARK).dictionary_encode()
    first = [key.rsplit(_MARK, len(columns) - 1) for key in keys.dictionary.to_pylist()]
    return pa.array([work(text, *map(int, numbers)) for text, *numbers in first], kind).take(keys.indices)


@F.arrow_udf(StringType())
def _forms(formula: pa.Array, row: pa.Array, col: pa.Array) -> pa.Array:
    return _each_once(form_of, pa.string(), formula, row, col)


def tokens(formula: Column) -> Column:
    """The tokens of a formula; joined, they are the formula."""
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(0))


def relative(formula: Column, row: Column, col: Column) -> Column:
    """The relative form of a formula in its cell, as a text."""
    return _forms(formula, row, col)


def _placed(part: Column, row: Column, col: Column) -> Column:
    """A coordinate of a relative form as it reads in a cell; null off the sheet."""
    kind, number = F.substr(part, F.lit(1), F.lit(1)), F.substring_index(part, ":", -1).cast("int")
    own = F.when(kind == "r", row).when(kind == "c", col).otherwise(0)
    at = number + own
    is_row = F.lower(kind) == "r"
    sign = F.when(kind.isin("R", "C"), "$").otherwise("")
    inside = (at >= 1) & (at <= F.when(is_row, LAST_ROW).otherwise(LAST_COLUMN))
    return F.when(inside, F.concat(sign, F.when(is_row, at.cast("string")).otherwise(column_letters(at))))


def absolute(form: Column, row: Column, col: Column) -> Column:
    """A relative form as the formula of a cell; null if a reference would leave the sheet."""

    def piece(t: Column) -> Column:
        # Cells stand side by side, whole columns and rows with a colon between.
        joint = F.when(F.lower(F.substr(t, F.lit(1), F.lit(1))) == F.lower(F.substr(F.substring_index(t, ",", -1), F.lit(1), F.lit(1))), ":").otherwise("")
        parts = F.transform(F.split(t, ","), lambda p: _placed(p, row, col))
        return let(parts, lambda p: F.concat(p[0], F.when(F.size(p) < 2, "").otherwise(joint), F.element_at(p, -1)))

    pieces = F.transform(F.split(form, _MARK), lambda t, i: F.when(i % 2 == 1, piece(t)).otherwise(t))
    return let(pieces, lambda x: F.when(~F.exists(x, lambda p: p.isNull()), F.array_join(x, "")))


def moved(formula: Column, row: Column, col: Column, to_row: Column, to_col: Column) -> Column:
    """The formula of cell (row, col) as it reads in another cell; unchanged where a reference would leave the sheet."""
    return F.coalesce(absolute(relative(formula, row, col), to_row, to_col), formula)


#: Cells that lines are written out to at a time.
CELLS_AT_ONCE = 50_000
_RANGE = re.compile(r"\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6})(?::\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6}))?")


def _range_of(line: str) -> tuple[int, int, int, int, str] | None:
    """First and last row, first and last column, and the formula of a line; null where it is none."""
    where, separator, formula = line.strip(" ").partition(SEPARATOR)
    where, formula = where.strip(" "), formula.strip(" ")
    found = _RANGE.fullmatch(where.upper())
    if not (separator and found and formula):
        return None
    row0, col0 = int(found[2]), _number(found[1])
    row1, col1 = int(found[4] or row0), _number(found[3] or found[1])
    return (row0, row1, col0, col1, f"={formula}") if row0 <= row1 <= LAST_ROW and col0 <= col1 <= LAST_COLUMN else None


def _cells_of(row0: int, row1: int, col0: int, col1: int, formula: str) -> Iterator[tuple[int, int, str]]:
    """row, col and formula of the cells of a range, row by row."""
    form = form_of(formula, row0, col0)
    for row in range(row0, row1 + 1):
        for col in range(col0, col1 + 1):
            yield row, col, formula_at(form, row, col) or formula


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id, at, line as batches of id, at and a list of the cells of each line, or of some of them; equal lines of a batch are written out once."""
    kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("formula", pa.string())]))
    named = lambda cells: [{"row": row, "col": col, "formula": formula} for row, col, formula in cells]
    for batch in batches:
        lines = batch.column(2).dictionary_encode()
        ranges = [line and _range_of(line) for line in lines.dictionary.to_pylist()]
        size = np.array([(r[1] - r[0] + 1) * (r[3] - r[2] + 1) if r else 0 for r in ranges] + [0], dtype=np.int64)
        code = lines.indices.fill_null(len(ranges)).to_numpy()
        total, begin = np.cumsum(size[code]), 0
        while begin < len(code):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] - size[code[begin]] + CELLS_AT_ONCE, "right")))
            which, given = np.unique(code[begin:end], return_inverse=True)
            cells = [_cells_of(*ranges[k]) if size[k] else iter(()) for k in which]
            # A line of more cells than these stands alone and comes in several lists.
            while any(parts := [named(islice(c, CELLS_AT_ONCE)) for c in cells]):
                made = pa.array(parts, kind).take(pa.array(given))
                yield pa.record_batch([*(batch.column(k).slice(begin, end - begin) for k in (0, 1)), made], names=["_id", "_at", "_cells"])
            begin = end


def _line_cells(lines: DataFrame, id_col: str, at: str, line: str, together: int | None) -> DataFrame:
    """id, at, row, col, formula of every cell that a line covers, once for each such line; dealt by sheet, in ``together`` parts, if that is given."""
    given = lines.select(F.col(id_col).alias("_id"), F.col(at).alias("_at"), line)
    cell = StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("formula", StringType())])
    made = given.mapInArrow(_written_out, StructType([*given.schema.fields[:2], StructField("_cells", ArrayType(cell))]))
    return (made.repartition(together, "_id") if together else made).select(F.col("_id").alias(id_col), "_at", F.inline("_cells"))


def expand(lines: DataFrame, *, id_col: str = "sheet", at: str = "at", line: str = "line", together: int | None = None) -> DataFrame:
    """id, row, col, formula (with its leading ``=``) of every cell that the lines of a sheet cover.

    Cells are dealt by their place, as large sheets need it.  With ``together``, they are dealt by sheet, in that many parts and
    before they are written out: for many small sheets, so that tables dealt alike are put together where they are.
    """
    key = [id_col, "row", "col"]
    cells = _line_cells(lines, id_col, at, line, together)
    # Dealt before the choice of the last line, which sorts cells once then.
    return (cells if together else cells.repartition(*key)).groupBy(*key).agg(F.max_by("formula", "_at").alias("formula"))


def _runs_of(batches: Iterator[pa.RecordBatch], along: str, end: str) -> Iterator[pa.RecordBatch]:
    """The first cell of each run with ``end``, its last place along an axis.

    Cells come in their order, ``_n`` is their number in their column or row: 1 begins the next one.
    A run goes on as long as places follow one another and relative forms are equal.
    """
    head, last, form = None, 0, None  # the first cell of the run that may go on; place and form of the cell before
    for batch in batches:
        if not batch.num_rows:
            continue
        if "_form" not in batch.schema.names:
            batch = batch.append_column("_form", _each_once(form_of, pa.string(), *(batch.column(k) for k in ("formula", "row", "col"))))
        place, number, forms = batch.column(along).to_numpy(), batch.column("_n").to_numpy(), batch.column("_form")
        begins = (number == 1) | (np.append(last, place[:-1]) + 1 != place)
        begins[1:] |= pc.not_equal(forms.slice(1), forms.slice(0, len(forms) - 1)).to_numpy(zero_copy_only=False)
        begins[0] |= head is None or forms[0].as_py() != form
        first = np.flatnonzero(begins)
        ends = np.append(last, place)[first]  # of the run before each
        heads = batch.take(pa.array(first))
        if len(first):
            done = [head] * (head is not None) + [heads.slice(0, len(first) - 1)]
            made = pa.Table.from_batches(done).append_column(end, pa.array(ends if head is not None else ends[1:], pa.int32()))
            yield from made.drop_columns(["_n"]).combine_chunks().to_batches()
            head = heads.slice(len(first) - 1)
        last, form = place[-1], forms[-1].as_py()
    if head is not None:
        yield head.append_column(end, pa.array([last], pa.int32())).drop_columns(["_n"])


def _runs(cells: DataFrame, across: list[str], along: str, end: str) -> DataFrame:
    """The first cell of each run of neighbours with equal relative forms, with the run's last place along the axis."""
    window = Window.partitionBy(*across).orderBy(along)
    ordered = cells.withColumn("_n", F.row_number().over(window)).sortWithinPartitions(*across, along)
    fields = [*cells.schema.fields, *([] if "_form" in cells.columns else [StructField("_form", StringType())]), StructField(end, IntegerType())]
    return ordered.mapInArrow(lambda batches: _runs_of(batches, along, end), StructType(fields))


def compress(cells: DataFrame, *, id_col: str = "sheet") -> DataFrame:
    """id, row, col, line: one line for each run of cells that repeat a formula, placed by its first cell.

    Runs go down a column first; cells left single are joined along their row.
    ``cells`` has id, row, col and formula (with its leading ``=``), at most one a cell.
    """
    used = cells.where(F.col("formula").isNotNull()).select(F.col(id_col).alias("_id"), F.col("row").cast("int"), F.col("col").cast("int"), "formula")
    down = _runs(used, ["_id", "col"], "row", "_row1")
    # A run down a column is a line of its own: its column keeps it apart from single cells and from other runs.
    apart = down.withColumn("_apart", F.when(F.col("_row1") > F.col("row"), F.col("col")).otherwise(0))
    runs = _runs(apart, ["_id", "row", "_apart"], "col", "_col1")
    first, last = cell_name(F.col("row"), F.col("col")), cell_name(F.col("_row1"), F.col("_col1"))
    where = F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))
    return runs.select(F.col("_id").alias(id_col), "row", "col", F.concat(where, F.lit(SEPARATOR), F.substr("formula", F.lit(2))).alias("line"))


def with_formulas(cells: DataFrame, formulas: DataFrame, *, id_col: str = "sheet") -> DataFrame:
    """id, row, col, text, formula of every cell that shows a text or has a formula; a formula alone shows nothing.

    Both tables have at most one row a cell.  They are stacked and grouped, which needs no exchange where both are dealt alike by sheet, as a join would.
    """
    empty = F.lit(None).cast("string")
    both = cells.select(id_col, "row", "col", "text", empty.alias("formula")).unionAll(formulas.select(id_col, "row", "col", empty.alias("text"), "formula"))
    return both.groupBy(id_col, "row", "col").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"), F.max("formula").alias("formula"))


def with_lines(cells: DataFrame, lines: DataFrame, *, id_col: str = "sheet", at: str = "at", line: str = "line", together: int | None = None) -> DataFrame:
    """What ``with_formulas`` gives of what ``expand`` gives of lines, with one sort for both."""
    key = [id_col, "row", "col"]
    made = _line_cells(lines, id_col, at, line, together)
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = made.schema["_at"].dataType
    both = cells.select(*key, "text", null("_at", kind), null("formula", "string")).unionAll(made.select(*key, null("text", "string"), "_at", "formula"))
    return (both if together else both.repartition(*key)).groupBy(*key).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"), F.max_by("formula", "_at").alias("formula"))
