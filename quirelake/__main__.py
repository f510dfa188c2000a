"""``python -m quirelake convert PATH OUT --to FORMAT``: files in, one converted file for each out, through Spark."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formats import decoded_file, format_of_path
from .plans.convert import Options, convert_df
from .plans.render import RENDERERS
from .sources.reader import PARSERS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, format and text of files; a file whose extension says nothing has a null format."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", format_of_path(F.col("path")).alias("format"), decoded_file(F.col("content")).alias("text"))


def convert_files(spark: SparkSession, path: str, to: str, options: Options | None = None, *, from_format: str | None = None) -> DataFrame:
    """path, converted and error of every file of a known text format."""
    files = read_files(spark, path)
    parts = None
    for fmt in [from_format] if from_format else list(PARSERS):
        chosen = files if from_format else files.where(F.col("format") == fmt)
        made = chosen.select("doc_id", "path").join(convert_df(chosen, fmt, to, options), "doc_id").select("path", "converted", "error")
        parts = made if parts is None else parts.unionByName(made)
    return parts


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quirelake")
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="convert files of text formats")
    convert.add_argument("path", help="a file, folder or glob that Spark can read")
    convert.add_argument("out", help="a folder for the Parquet result")
    convert.add_argument("--to", choices=sorted(RENDERERS), required=True)
    convert.add_argument("--from", dest="from_format", choices=sorted(PARSERS))
    convert.add_argument("--extract-html", action="store_true")
    convert.add_argument("--discard-links", action="store_true")
    convert.add_argument("--code-parsing", action="store_true", help="paragraphs that look like code become code blocks")
    convert.add_argument("--image-handling", default="auto")
    args = parser.parse_args(arguments)
    options = Options(extract_html=args.extract_html, discard_links=args.discard_links, image_handling=args.image_handling, code_parsing=args.code_parsing)
    spark = SparkSession.builder.getOrCreate()
    convert_files(spark, args.path, args.to, options, from_format=args.from_format).write.parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
