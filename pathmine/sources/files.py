"""File-tree sources (A1, A2) and the size limit.

Paths and lengths are listed first: the extension is a path glob, the length limit is a filter that the file scan applies
before it opens a file, and only what is left is read. Text is decoded leniently: bytes that are no UTF-8 are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source-file extensions accepted by the original tool (case-sensitive).
SOURCE_EXTENSIONS = ["cpp", "CPP", "c++", "cp", "cxx", "hpp", "HPP", "c", "h", "C", "cc"]
EXT_PATTERN = r"\.(" + "|".join(e.replace("+", r"\+") for e in SOURCE_EXTENSIONS) + r")$"
#: A file over this size fits no row.
LARGEST_FILE = (1 << 31) - 1024
_MARK, _BAD = "\uFDD0", "\uFFFD"


def is_source_file(path_col) -> Column:
    """B1: path ends with one of the accepted extensions."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return c.rlike(EXT_PATTERN)


def lenient_text(content) -> Column:
    """Bytes as text without the bytes that are no UTF-8. A replacement character that the text itself holds stays."""
    raw = (F.col(content) if isinstance(content, str) else content).cast("string")
    hidden = F.replace(F.replace(raw, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_BAD), F.lit(_MARK + "1"))
    valid = F.replace(F.make_valid_utf8(hidden), F.lit(_BAD), F.lit(""))
    return F.replace(F.replace(valid, F.lit(_MARK + "1"), F.lit(_BAD)), F.lit(_MARK + "0"), F.lit(_MARK))


def file_size_ok(length_col="length", max_file_size: int | None = None) -> Column:
    """A file of at most ``max_file_size`` bytes (None: any that fits a row)."""
    c = F.col(length_col) if isinstance(length_col, str) else length_col
    return c <= F.lit(LARGEST_FILE if max_file_size is None else min(max_file_size, LARGEST_FILE)).cast("long")


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Every file below ``root``: binaryFile rows; bytes are read only where ``content`` is used. ``extensions`` prunes
    the listing itself. As in every Spark listing, empty files and names that begin with a dot or underscore are no part."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions is not None:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else "*." + "".join(extensions))
    return reader.load(root)


def scan_sources(spark: SparkSession, root: str, decode: bool = True, extensions: list[str] | None = None,
                 max_file_size: int | None = None) -> DataFrame:
    """A1: every file under each project directory of ``root``: (project, path, content, length).

    Files directly under ``root`` belong to no project and are skipped (Q28). Files over ``max_file_size`` bytes (or the
    size that fits a row) and, with ``extensions``, other files are never opened. ``decode`` gives text (``lenient_text``)."""
    df = list_files(spark, root, extensions).where(file_size_ok("length", max_file_size))
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    rel = F.substring_index(F.col("path"), base + "/", -1)
    df = df.withColumn("_rel", rel).where(F.col("_rel").contains("/"))
    return df.select(
        F.regexp_extract("_rel", r"^([^/]+)/", 1).alias("project"),
        F.col("_rel").alias("path"),
        (lenient_text("content") if decode else F.col("content")).alias("content"),
        F.col("length"),
    )


def scan_functions(spark: SparkSession, directory: str, max_file_size: int | None = None) -> DataFrame:
    """A2 + B5: numbered function files ``<n>.c`` of at most ``max_file_size`` bytes: (fn_id, code, length); other names
    are skipped."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.c").load(directory).where(file_size_ok("length", max_file_size))
    fid = F.regexp_extract("path", r"/(\d+)\.c$", 1)
    return df.where(fid != "").select(fid.cast("long").alias("fn_id"), lenient_text("content").alias("code"), F.col("length"))
