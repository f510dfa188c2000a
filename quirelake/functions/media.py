"""Addresses, files, frames and dates of media and sheets, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_remote(src: Column) -> Column:
    """Whether an address is on the web."""
    return src.rlike("^(?i:https?:)?//")


def has_scheme(src: Column) -> Column:
    """Whether an address names a scheme; one letter is a drive."""
    return src.rlike("^[A-Za-z][A-Za-z0-9+.-]+:")


def resolve_local(src: Column, base: Column) -> Column:
    """A relative path below its base; remote and absolute addresses stay."""
    stays = is_remote(src) | has_scheme(src) | src.rlike(r"^([A-Za-z]:)?[/\\]")
    return F.when(stays, src).otherwise(F.concat(F.regexp_replace(base, r"[/\\]+$", ""), F.lit("/"), src))


def image_filename(url: Column) -> Column:
    """The last segment of a URL's path, or a name from its digest if that is no file name."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.try_url_decode(F.element_at(F.split(path, "/"), -1))
    return F.when(last.contains("."), last).otherwise(F.concat(F.lit("image_"), F.substring(F.md5(url), 1, 8), F.lit(".png")))


def sanitized_filename(name: Column) -> Column:
    """Safe characters only; 80 for the base and 10 for the extension at most."""
    safe = F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
    base, extension = F.regexp_replace(safe, r"\.[^.]*$", ""), F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    return F.concat(F.substring(base, 1, 80), F.substring(extension, 1, 10))


def extension_of_type(content_type: Column) -> Column:
    """The extension of an image type, or null."""
    bare = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    kind = F.regexp_extract(bare, r"^image/([a-z0-9]+)", 1)
    return F.when(kind == "", F.lit(None)).when(kind == "jpeg", ".jpg").otherwise(F.concat(F.lit("."), kind))


def data_url_bytes(src: Column) -> Column:
    """The bytes of a data URL, base64 or percent-encoded, or null."""
    head, body = F.regexp_extract(src, "^data:([^,]*),", 1), F.regexp_extract(src, "(?s)^data:[^,]*,(.*)$", 1)
    encoded = F.try_to_binary(body, F.lit("base64"))
    return F.when(~src.startswith("data:"), F.lit(None)).when(head.endswith(";base64"), encoded).otherwise(F.try_url_decode(body).cast("binary"))


def data_url(data: Column, content_type: Column) -> Column:
    """Bytes as a data URL."""
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), F.base64(data))


def box_text(x: Column, y: Column, w: Column, h: Column, font: Column) -> Column:
    """The line that stands before the text of a box."""
    size = F.regexp_replace(F.format_string("%.1f", font.cast("double")), r"\.0$", "")
    return F.format_string("Text box (x %d%%, y %d%%, w %d%%, h %d%%, font %spt)", x, y, w, h, size)


def box_of_text(line: Column) -> Column:
    """x, y, w, h and font of such a line, or null."""
    pattern = r"^Text box \(x (\d+)%, y (\d+)%, w (\d+)%, h (\d+)%, font ([\d.]+)pt\)"
    numbers = [F.regexp_extract(line, pattern, k) for k in range(1, 6)]
    fields = [c.try_cast("double" if n == "font" else "int").alias(n) for c, n in zip(numbers, ("x", "y", "w", "h", "font"), strict=True)]
    return F.when(line.rlike(pattern), F.struct(*fields))


def sheet_serial(value: Column) -> Column:
    """A timestamp as a spreadsheet's serial: days since 1899-12-30 with the time as a fraction."""
    seconds = F.unix_timestamp(value) - F.unix_timestamp(F.lit("1899-12-30 00:00:00").cast("timestamp"))
    return seconds / 86400.0


def property_text(value: Column, most: int = 255) -> Column:
    """A file property: one line, cut at a word within its length."""
    line = F.trim(F.regexp_replace(value, r"\s+", " "))
    cut = F.regexp_extract(F.substring(line, 1, most + 1), r"^(.*)\s", 1)
    return F.when(F.length(line) <= most, line).when(cut != "", cut).otherwise(F.substring(line, 1, most))


def frame_percent(part: Column, whole: Column) -> Column:
    """A length as a rounded percentage of a slide's."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 0)).otherwise(0.0).cast("int")
