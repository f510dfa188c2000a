"""Workbooks of spreadsheets as a table of cells, and their sheets as CSV.

A workbook is a zip archive of XML parts (ECMA-376).  A small map unpacks it,
sheet by sheet, large ones as a stream, into one row for each used cell; what cells show,
the grids and the CSV texts are made by Spark from that table.  Parts that repeat from
workbook to workbook are read, or made, once by a worker.

Defined results: hidden sheets are left out; what is no workbook, or a null,
has one row with an error; a cell without a stored value is empty; a formula
that shares another cell's text reads as that text, moved; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_cell, format_number
from ..functions.values import let
from ..operators.formulas import cell_name, moved_text

CELLS = "path string, sheet_no int, sheet string, row int, col int, kind string, raw string, formula string, error string"
NAMES = [c.strip().split()[0] for c in CELLS.split(",")]
ROWS = 20_000
#: Workbooks and bytes of them that one batch holds at most, but for a single larger one.
BOOKS, BOOK_BYTES = 1_000, 8_000_000
#: Bytes of a part that is parsed at once; larger ones are read as a stream.
WHOLE_PART = 1_000_000
#: Bytes of the list of sheets that a worker remembers.
REMEMBERED = 20_000
# The built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Days from the first day of either calendar of serial numbers to 1970-01-01.
DAYS_1900, DAYS_1904 = 25_569, 24_107


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(element: ElementTree.Element) -> str:
    return _local(element.tag)


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without readings of them."""
    if _name(element) == "t":
        return element.text or ""
    return "".join(_text(e) for e in element if _name(e) in ("t", "r"))


def _elements(archive: zipfile.ZipFile, part: str, kind: str) -> Iterable[ElementTree.Element]:
    """The elements of a kind in a part, those of a large part each dropped after use; a part that is missing has none."""
    if part not in archive.namelist():
        return ()
    if archive.getinfo(part).file_size <= WHOLE_PART:
        try:
            return _of_kind(ElementTree.fromstring(archive.read(part)), kind)
        except ElementTree.ParseError:
            pass  # read as a stream, up to where it breaks
    return _streamed(archive, part, kind)


def _of_kind(root: ElementTree.Element, kind: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e.tag) == kind]


def _streamed(archive: zipfile.ZipFile, part: str, kind: str) -> Iterator[ElementTree.Element]:
    with archive.open(part) as source:
        for _, element in ElementTree.iterparse(source):
            if _name(element) == kind:
                yield element
            if _name(element) in (kind, "row"):
                element.clear()


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Places of the cell styles that show dates or times."""
    bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in _elements(archive, "xl/styles.xml", "numFmt")}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search("[dmyhs]", bare(code), re.I)}
    for styles in _elements(archive, "xl/styles.xml", "cellXfs"):
        return {at for at, style in enumerate(styles) if int(style.get("numFmtId", 0)) in dates}
    return set()


@lru_cache(64)
def _listed(workbook: bytes, links: bytes) -> tuple[list[tuple[str, str]], bool]:
    """Names and parts of the visible sheets, and whether days count from 1904."""
    elements = lambda data, kind: _of_kind(ElementTree.fromstring(data), kind) if data else []
    targets = {_attribute(r, "Id"): _attribute(r, "Target") or "" for r in elements(links, "Relationship")}
    old = any(p.get("date1904") in ("1", "true") for p in elements(workbook, "workbookPr"))
    sheets = []
    for s in elements(workbook, "sheet"):
        if s.get("state", "visible") == "visible":
            target = targets.get(_attribute(s, "id"), "")
            sheets.append((s.get("name", ""), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return sheets, old


@lru_cache(16_384)
def _place(name: str) -> tuple[int, int] | None:
    """Row and column of a cell, from 0."""
    place = re.fullmatch(r"([A-Z]{1,3})(\d{1,7})", name)
    if not place:
        return None
    col = 0
    for letter in place[1]:
        col = 26 * col + ord(letter) - 64
    return int(place[2]) - 1, col - 1


def _shared(formula: ElementTree.Element | None) -> int | None:
    """The number of the text that a formula shares."""
    number = formula.get("si") if formula is not None and formula.get("t") == "shared" else None
    return number and int(number)


def _shared_texts(archive: zipfile.ZipFile, part: str) -> dict[int, tuple[int, int, str]]:
    """Row, column and formula of the first cell, by rows, that holds the text of each shared formula."""
    first: dict[int, tuple[int, int, str]] = {}
    for c in _elements(archive, part, "c"):
        place = _place(c.get("r", ""))
        for f in [e for e in c if _name(e) == "f"][-1:]:
            number = _shared(f)
            if place and f.text and number is not None and (number not in first or place < first[number][:2]):
                first[number] = (*place, f"={f.text}")
    return first


# The plainest form of rows: nothing but cells of values, texts in line and formulas of their own, in attributes' usual order.
_PLAIN_TEXT = r"[^<>&\r\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]*+(?:&(?:amp|lt|gt|quot|apos);[^<>&\r\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]*+)*+"
_PLAIN_CELL = (
    rf'<c r="([A-Z]{{1,3}}[0-9]{{1,7}})"(?: s="([0-9]{{1,9}})")?(?: t="([A-Za-z]+)")?>'
    rf'(?:<f>({_PLAIN_TEXT})</f>)?(?:<v>({_PLAIN_TEXT})</v>|<is><t(?: xml:space="preserve")?>(?!<)({_PLAIN_TEXT})</t></is>)?</c>'
)
_PLAIN_CELLS = re.compile(_PLAIN_CELL)
_PLAIN_ROWS = re.compile(f'(?:<row r="[0-9]++">(?:{re.sub(r"[(](?![?])", "(?:", _PLAIN_CELL)})*+</row>)*+')


@lru_cache(64)
def _is_plain(shell: str) -> bool:
    """Whether a sheet without its rows is well-formed UTF-8 XML in which rows can stand only where they stood."""
    if not shell.startswith('<?xml version="1.0" encoding="UTF-8"') or "<!" in shell or shell.count("<?") > 1:
        return False
    try:
        names = [_name(e) for e in ElementTree.fromstring(shell.encode()).iter()]
    except (ElementTree.ParseError, ValueError):
        return False
    return names.count("sheetData") == 1 and "c" not in names


def _unescaped(text: str) -> str:
    if "&" in text:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = text.replace(name, char)
    return text


def _plain_cells(data: bytes) -> list[tuple[str, str, str, str, str, str]] | None:
    """Name, style, type, formula, value and text in line of the cells of a sheet in the plainest form; null for others, which take the whole parser."""
    try:
        head, begin, rest = data.decode().partition("<sheetData>")
    except UnicodeDecodeError:
        return None
    rows, end, tail = rest.rpartition("</sheetData>")
    shell = f"{head}{begin}{end}{tail}"
    plain = begin and end and len(shell) <= REMEMBERED and _is_plain(shell) and _PLAIN_ROWS.fullmatch(rows)
    return _PLAIN_CELLS.findall(rows) if plain else None


KINDS = {"s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error", "d": "text"}


def cells_of(content: bytes) -> Iterator[tuple]:
    """sheet_no, sheet, row, col, kind, raw and formula of the used cells of visible sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        workbook, links = (archive.read(part) if part in names else b"" for part in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"))
        sheets, old = (_listed if len(workbook) + len(links) <= REMEMBERED else _listed.__wrapped__)(workbook, links)
        strings = [_text(s) for s in _elements(archive, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(archive)
        for number, (sheet, part) in enumerate(sheets):
            texts = None
            plain = _plain_cells(archive.read(part)) if part in names and archive.getinfo(part).file_size <= WHOLE_PART else None
            if plain is not None:
                for at, style, form, formula, value, text in plain:
                    place = _place(at)
                    raw = _unescaped(value or text) or None
                    kind = KINDS.get(form, "number")
                    if form == "s" and raw is not None:
                        raw = strings[int(raw)]
                    elif dates and kind == "number" and int(style or 0) in dates:
                        kind = "date1904" if old else "date"
                    if raw is not None or formula:
                        yield number, sheet, *place, kind, raw, f"={_unescaped(formula)}" if formula else None
                continue
            for c in _elements(archive, part, "c"):
                place = _place(c.get("r", ""))
                if not place:
                    continue
                value = inside = held = shared = formula = None
                for e in c:
                    name = _local(e.tag)
                    if name == "v":
                        value = e
                    elif name == "f":
                        held = e
                    elif name == "is":
                        inside = e
                raw = value.text if value is not None else _text(inside) if inside is not None else None
                if held is not None:
                    shared = _shared(held)
                    if held.text:
                        formula = f"={held.text}"
                    elif shared is not None:
                        texts = _shared_texts(archive, part) if texts is None else texts
                        row, col, text = texts.get(shared, (0, 0, None))
                        formula = text and moved_text(text, row + 1, col + 1, place[0] + 1, place[1] + 1)
                form = c.get("t", "n")
                kind = KINDS.get(form, "number")
                if form == "s" and raw is not None:
                    raw = strings[int(raw)]
                elif dates and kind == "number" and int(c.get("s", 0)) in dates:
                    kind = "date1904" if old else "date"
                if raw is not None or formula is not None or shared is not None:
                    yield number, sheet, *place, kind, raw, formula


def workbook_cells(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """The cell table of workbooks, as ``binaryFile`` reads them: one map, which reads each workbook once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [()] * len(NAMES)
            kinds = [pa.int32() if n in ("sheet_no", "row", "col") else pa.string() for n in NAMES]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

        made: list[tuple] = []
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for cell in cells_of(data.as_py() or b""):
                        made.append((where, *cell, None))
                        if len(made) == ROWS:
                            yield batch_of(made)
                            made = []
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError, KeyError) as e:
                    made.append((where, *[None] * 7, f"no workbook: {e}"))
        yield batch_of(made)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, CELLS)


def _as_date(serial: Column, days: Column) -> Column:
    """A serial number of days in ISO form; ``days`` lie between the first one and 1970-01-01."""
    begin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")  # no zone: serials are what a clock shows
    stamp = begin + F.make_dt_interval(secs=F.round((serial - days) * 86_400).cast("decimal(18,6)"))
    whole, clock = serial == F.floor(serial), serial < 1
    as_text = lambda form: F.date_format(stamp, form)
    return F.when(whole & ~clock, as_text("yyyy-MM-dd")).when(clock, as_text("HH:mm:ss")).otherwise(as_text("yyyy-MM-dd HH:mm:ss"))


def shown() -> Column:
    """What a cell shows: numbers without a needless fraction, dates in ISO form, TRUE and FALSE.

    Dates stand in a ``let``, apart from the code that Spark makes of the stage: with them it has more than the 8,000 bytes that the JVM compiles, and every cell pays.
    """
    raw = F.col("raw")
    days = F.when(F.col("kind") == "date", F.lit(DAYS_1900)).otherwise(DAYS_1904)
    serial = raw.try_cast("double")
    date = let(F.struct(serial.alias("at"), days.alias("days")), lambda x: _as_date(x["at"], x["days"]))
    return (
        F.when(raw.isNull(), "").when(F.col("kind") == "boolean", F.when(raw == "1", "TRUE").otherwise("FALSE"))
        .when(F.col("kind").startswith("date"), date).when(F.col("kind") == "number", format_number(serial)).otherwise(raw)
    )


def csv_files(cells: DataFrame) -> DataFrame:
    """path, sheet, suffix, csv: every sheet from A1 to its last used cell, in UTF-8 with its mark.

    The suffix is empty for the only sheet of a workbook, else ``_`` and the
    sheet's name as a part of a file name.
    """
    used = cells.where("error is null").withColumn("text", shown())
    key = ["path", "sheet_no", "sheet"]
    sheets = used.groupBy(*key).agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    grid = sheets.select(*key, "_cols", F.explode(F.sequence(F.lit(0), "_rows")).alias("row"))
    rows = used.groupBy("path", "sheet_no", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), "_cols"), lambda c: csv_cell(F.coalesce(F.col("by_col")[c], F.lit("")))), ",")
    lines = grid.join(rows, ["path", "sheet_no", "row"], "left").select(*key, "row", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "line")))
    texts = lines.groupBy(*key).agg(F.concat(F.lit("﻿"), F.array_join(ordered["line"], "\r\n"), F.lit("\r\n")).alias("csv"))
    n = sheets.groupBy("path").agg(F.count("*").alias("_n"))
    part = F.regexp_replace("sheet", r'[<>:"/\\|?*\x00-\x1f]', "_")
    return texts.join(n, "path").select("path", "sheet", F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit("_"), part)).alias("suffix"), "csv")


def _xml(text: Column) -> Column:
    """Text inside an element; control characters that XML has no form for become spaces."""
    bare = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.replace(F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit("&#13;"))


# The parts of a workbook besides its sheets.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@lru_cache(64)
def _frame(names: tuple[str, ...]) -> bytes:
    """An archive of what a workbook of sheets of these names holds besides them."""
    from xml.sax.saxutils import quoteattr

    n = range(1, len(names) + 1)
    override = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPES}.worksheet+xml"/>' for k in n)
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, names, strict=True))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>{override}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
    }
    return _with_parts(b"", parts)


def _with_parts(content: bytes, parts: dict[str, str]) -> bytes:
    """An archive with more parts at its end."""
    out = io.BytesIO(content)
    with zipfile.ZipFile(out, "a") as archive:
        for name, text in parts.items():
            # One date for all parts, so that equal cells give equal bytes.
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _archive(sheets: list[tuple[str, str]]) -> bytes:
    """A workbook of sheets: their names, and their rows as XML."""
    names = tuple(name for name, _ in sheets)
    frame = (_frame if sum(map(len, names)) <= REMEMBERED else _frame.__wrapped__)(names)
    return _with_parts(frame, {f"xl/worksheets/sheet{k}.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{xml}</sheetData></worksheet>' for k, (_, xml) in enumerate(sheets, 1)})


def _sheets(cells: list[tuple]) -> list[tuple[str, str]]:
    """Name and XML of each sheet of a workbook, from sheet_no, sheet, row and XML of its cells in their order."""
    return [
        (sheet, "".join(f'<row r="{row + 1}">{"".join(c[3] or "" for c in held)}</row>' for row, held in groupby(of_sheet, key=itemgetter(2))))
        for (_, sheet), of_sheet in groupby(cells, key=itemgetter(0, 1))
    ]


def _values(column: pa.Array) -> list:
    """The values of a column; numpy takes them over faster than one by one."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[tuple]]]:
    """Path and cells of each workbook; batches have path, number in the workbook, sheet_no, sheet, row and XML of cells in their order."""
    where, held = None, []
    for batch in batches:
        path, number, *cell = map(_values, batch.columns)
        for at, n, made in zip(path, number, zip(*cell, strict=True), strict=True):
            if n == 1 and held:
                yield where, held
                held = []
            where = at
            held.append(made)
    if held:
        yield where, held


def workbook_files(cells: DataFrame) -> DataFrame:
    """path and content (the bytes of a workbook) from a cell table.

    ``cells`` has path, sheet_no, sheet, row and col (from 0), kind (number, boolean or text), raw and
    formula.  Spark makes the XML of cells and sorts it; a small map joins and packs what is ready.  Formulas
    are written without a stored value where ``raw`` is null; sheets of a path come in the order of their numbers.
    """
    name = cell_name(F.col("row") + 1, F.col("col") + 1)
    formula = F.when(F.col("formula").isNotNull(), F.concat(F.lit("<f>"), _xml(F.substr("formula", F.lit(2))), F.lit("</f>"))).otherwise("")
    value = F.when(F.col("raw").isNull(), "").otherwise(F.concat(F.lit("<v>"), _xml(F.col("raw")), F.lit("</v>")))
    inline = F.concat(F.lit('<is><t xml:space="preserve">'), _xml(F.col("raw")), F.lit("</t></is>"))
    is_text = F.col("kind") == "text"
    kind = F.when(is_text & F.col("formula").isNull(), ' t="inlineStr"').when(is_text, ' t="str"').when(F.col("kind") == "boolean", ' t="b"').otherwise("")
    body = F.when(is_text & F.col("formula").isNull(), inline).otherwise(F.concat(formula, value))
    cell = F.concat(F.lit('<c r="'), name, F.lit('"'), kind, F.lit(">"), body, F.lit("</c>"))
    used = cells.where("raw is not null or formula is not null").select(F.col("path").cast("string"), "sheet_no", "sheet", "row", "col", cell.alias("xml"))
    # The number of a cell in its workbook: 1 begins the next one.
    order = ["sheet_no", "sheet", "row", "col", "xml"]
    placed = used.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).sortWithinPartitions("path", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda made: pa.record_batch([pa.array([where for where, _ in made], pa.string()), pa.array([data for _, data in made], pa.binary())], names=["path", "content"])
        made: list[tuple[str | None, bytes]] = []
        size = 0
        for where, held in _books(batches):
            made.append((where, _archive(_sheets(held))))
            size += len(made[-1][1])
            if len(made) == BOOKS or size >= BOOK_BYTES:
                yield batch_of(made)
                made, size = [], 0
        yield batch_of(made)

    return placed.select("path", "n", "sheet_no", "sheet", "row", "xml").mapInArrow(run, "path string, content binary")
