"""Text files as documents and questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import content_id, strip

DEFAULT_EXTENSIONS = (".txt", ".md")
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# --- fixed values: file types by extension ------------------------------------------
FILE_TYPES = {".txt": "txt", ".md": "markdown"}
# --------------------------------------------------------------------------------------


def _glob(extensions: Sequence[str]) -> str:
    """Glob that matches the extensions in any letter case, so other files are never opened."""
    names = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(names) + "}"


def _documents(files: DataFrame) -> DataFrame:
    """Document rows of ``binaryFile`` rows; files that are not UTF-8 are left to ``rejected_files``."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.lit(None).cast("string")
    for ext, file_type in FILE_TYPES.items():
        kind = F.when(suffix == ext, file_type).otherwise(kind)
    # text mode reads every line end as a line feed
    content = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return (
        files.select(
            F.regexp_replace("path", "^file:/*", "/").alias("source"),
            name.alias("filename"),
            kind.alias("file_type"),
            F.col("length").alias("size_bytes"),
            content.alias("content"),
        )
        .where("content IS NOT NULL")
        .withColumn("doc_id", content_id(F.col("source"), F.col("content")))
    )


def metadata_map() -> Column:
    """Well-known document columns as the metadata map the validators read."""
    return F.map_filter(
        F.create_map(
            *[x for c in ("source", "filename", "file_type") for x in (F.lit(c), F.col(c))],
            F.lit("size_bytes"),
            F.col("size_bytes").cast("string"),
        ),
        lambda _k, v: v.isNotNull(),
    )


def _files(spark: SparkSession, path: str, extensions: Sequence[str], recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob([e.lower() for e in extensions]))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def load_directory(
    spark: SparkSession, path: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS, recursive: bool = True
) -> DataFrame:
    """All text files below a folder (S3).

    A missing folder or a file that cannot be read raises; files that are not text
    are rows of ``rejected_files``.
    """
    return _documents(_files(spark, path, extensions, recursive))


def rejected_files(
    spark: SparkSession, path: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS, recursive: bool = True
) -> DataFrame:
    """``source, size_bytes, error`` of the files that ``load_directory`` leaves out (S3, A5)."""
    files = _files(spark, path, extensions, recursive)
    broken = files.where(F.try_validate_utf8(F.col("content").cast("string")).isNull())
    return broken.select(
        F.regexp_replace("path", "^file:/*", "/").alias("source"),
        F.col("length").alias("size_bytes"),
        F.lit("not valid UTF-8").alias("error"),
    )


def load_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files."""
    return load_directory(spark, path, [".txt"])


def load_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files."""
    return load_directory(spark, path, [".md"])


def stream_directory(
    spark: SparkSession, path: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS, files_per_batch: int = 1000
) -> DataFrame:
    """New text files of a folder as a stream of documents."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", _glob([e.lower() for e in extensions]))
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return _documents(files)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines of question files, numbered in the order of file name and line.

    A file is one row until its lines are numbered, so the numbers do not depend on
    how it is split; the counts of earlier files give each file its first number.
    """
    asked = F.filter(F.transform(F.split("value", "\r\n?|\n"), strip), lambda q: q != "")
    texts = spark.read.text(path, wholetext=True)
    files = texts.select(F.col("_metadata.file_path").alias("_file"), asked.alias("_lines"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = files.select("_file", F.size("_lines").alias("_n"))
    first = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = files.join(first, "_file").select("_first", F.posexplode("_lines").alias("_line", "query"))
    return numbered.select((F.col("_first") + F.col("_line")).cast("long").alias("query_id"), "query")
