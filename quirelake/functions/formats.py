"""Formats as a relation: inference from paths, media types and first bytes; charset decoding; option resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats in their order, with extensions, whether binary, image outputs, media types (a prefix ends in /).
INPUTS = [
    ("markdown", [".md", ".markdown"], False, [], ["text/markdown", "text/x-markdown"]),
    ("text", [".txt", ".text"], False, [], []),
    ("html", [".html", ".htm"], False, [], ["text/html", "application/xhtml+xml"]),
    ("latex", [".tex", ".latex"], False, [], ["application/x-tex", "text/x-tex"]),
    ("json", [".aston"], False, [], ["application/json"]),
    ("pdf", [".pdf"], True, [], ["application/pdf"]),
    ("docx", [".docx"], True, [], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]),
    ("pptx", [".pptx"], True, [], ["application/vnd.openxmlformats-officedocument.presentationml.presentation"]),
    ("csv", [".csv", ".tsv"], False, [], ["text/csv", "text/tab-separated-values"]),
    ("xlsx", [".xlsx"], True, [], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]),
    ("image", [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"], True, [], ["image/"]),
]
OUTPUTS = [
    ("markdown", [".md", ".markdown"], False, ["link", "embed"], []),
    ("html", [".html", ".htm"], False, ["embed", "link"], []),
    ("latex", [".tex", ".latex"], False, ["link"], []),
    ("json", [".aston"], False, ["embed", "link"], []),
    ("text", [".txt"], False, [], []),
    ("pdf", [".pdf"], True, ["embed"], []),
    ("docx", [".docx"], True, ["embed"], []),
    ("pptx", [".pptx"], True, ["embed"], []),
    ("csv", [".csv"], False, [], []),
    ("xlsx", [".xlsx"], True, ["embed"], []),
]
HANDLINGS = ("auto", "keep", "discard", "describe", "transcribe")


def check_choice(kind: str, value: str, choices: Sequence[str]) -> None:
    """An error that names the accepted values, before any work."""
    if value not in choices:
        raise ValueError(f"{kind} {value!r} is none of {', '.join(choices)}")


def formats(spark: SparkSession, direction: str = "input") -> DataFrame:
    """The registry as a relation."""
    rows = [(i, *f) for i, f in enumerate(INPUTS if direction == "input" else OUTPUTS)]
    return spark.createDataFrame(rows, "place int, name string, extensions array<string>, binary boolean, image_outputs array<string>, media_types array<string>")


def format_of_path(path: Column, direction: str = "input") -> Column:
    """The first format that lists the path's extension, or null; a CASE, so it needs no join."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions, *_ in reversed(INPUTS if direction == "input" else OUTPUTS):
        out = F.when(extension.isin(*extensions), F.lit(name)).otherwise(out)
    return out


def format_of_media_type(media_type: Column) -> Column:
    """The first format of a media type, exact or by a prefix that ends in a slash, or null."""
    bare = F.lower(F.trim(F.split_part(media_type, F.lit(";"), F.lit(1))))
    out = F.lit(None).cast("string")
    for name, _, _, _, types in reversed(INPUTS):
        for t in types:
            out = F.when(bare.startswith(t) if t.endswith("/") else bare == t, F.lit(name)).otherwise(out)
    return out


def magic_ok(data: Column, fmt: Column) -> Column:
    """Whether first bytes fit a binary format: a PDF mark within 1024 bytes, a zip for office files."""
    head = F.decode(F.substring(data, 1, 1024), "ISO-8859-1")
    return F.when(fmt == "pdf", head.contains("%PDF-")).when(fmt.isin("docx", "pptx", "xlsx"), head.startswith("PK\x03\x04")).otherwise(F.lit(True))


def windows_1252(data: Column) -> Column:
    """Bytes as Windows-1252: Latin-1, but for the 32 control characters above ASCII."""
    controls = "".join(map(chr, range(0x80, 0xA0)))
    shown = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
    return F.translate(F.decode(data, "ISO-8859-1"), controls, shown)


def decoded_file(data: Column) -> Column:
    """Text of a file's bytes: UTF-16 by its mark, else UTF-8 without its mark, else Windows-1252."""
    mark = F.hex(F.substring(data, 1, 2))
    utf8 = F.try_validate_utf8(data.cast("string"))
    plain = F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", F.expr("null")).otherwise(utf8)
    without = F.regexp_replace(F.coalesce(plain, utf8), "^\ufeff", "")
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(data, "UTF-16")).when(utf8.isNotNull(), without).otherwise(windows_1252(data))


def decoded_page(data: Column, charset: Column) -> Column:
    """Text of a page's bytes: the charset of its header, else of its first 4096 bytes, else UTF-8."""
    declared = F.regexp_extract(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1)
    name = F.lower(F.coalesce(charset, F.nullif(declared, F.lit(""))))
    out = F.make_valid_utf8(data.cast("string"))
    out = F.when(name == "windows-1252", windows_1252(data)).otherwise(out)
    return F.when(name == "utf-16", F.decode(data, "UTF-16")).when(name.isin("iso-8859-1", "us-ascii"), F.decode(data, "ISO-8859-1")).otherwise(out)


def image_plan(spark: SparkSession) -> DataFrame:
    """Every handling for every source and target: what ``auto`` means and where images go."""
    handling = spark.createDataFrame([(h,) for h in HANDLINGS], "asked string")
    sources = formats(spark).select(F.col("name").alias("source"))
    targets = formats(spark, "output").select(F.col("name").alias("target"), "image_outputs")
    auto = F.when(F.col("source").isin("image", "latex"), "transcribe").when(F.col("target").isin("csv", "text"), "discard").otherwise("keep")
    # A cross join of three relations of fixed size, a few hundred rows.
    return handling.crossJoin(sources).crossJoin(targets).select(
        "asked", "source", "target", F.when(F.col("asked") == "auto", auto).otherwise(F.col("asked")).alias("handling"),
        F.when(F.size("image_outputs") > 0, F.col("image_outputs")[0]).alias("output"), (F.col("asked") != "auto").alias("required"),
    )
