"""File corpora: path rules run on file metadata, so excluded files are never opened."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import computed_once
from ..functions.paths import is_excluded, relative_to, slashes
from ..functions.review import extension
from .tree import list_tree, local_folder, read_files

# Names never entered and extensions never read.
EXCLUDED_NAMES = (
    "node_modules", ".git", "dist", "build", ".next", "coverage", ".vscode", ".idea",
    "__pycache__", ".mypy_cache", ".ruff_cache",
)
BINARY_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib",
    ".mp3", ".mp4", ".avi", ".mov",
    ".woff", ".woff2", ".ttf", ".eot",
    ".pyc", ".class", ".o", ".a",
)

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def decode(content: Column) -> Column:
    """Text of a file: invalid bytes dropped, all line ends made "\\n".

    A replacement character that was really in the file is dropped too.
    """
    text = F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def is_scannable(rel_path: Column, extra_names: Sequence[str] = (), max_depth: int | None = None) -> Column:
    """Depth, excluded names and binary extensions, from the path alone."""
    names = list(dict.fromkeys([*EXCLUDED_NAMES, *(n.rstrip("/") for n in extra_names)]))
    segments = F.split(slashes(rel_path), "/")
    shallow = F.lit(True) if max_depth is None else F.size(segments) <= max_depth
    return (
        shallow
        & ~F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names]))
        & ~F.coalesce(extension(rel_path), F.lit("")).isin(*BINARY_EXTENSIONS)
    )


def read_corpus(
    spark: SparkSession,
    root: str,
    exclude_paths: Sequence[str] = (),
    max_depth: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """(file, text) rows of a directory tree; file is relative to the root.

    A mounted folder is listed and read inside tasks: excluded folders are not
    entered, links are passed over, and what may not be read gives no rows.

    Other stores, single files and globs go through Spark's reader, which lists
    on the driver and passes over names that start with "." or "_". Such
    directories are handed over as roots of their own and such files are read
    beside them. Links are not told apart from files there.
    """
    base = local_folder(root)
    if base is not None:
        root = base.decode("utf-8", "replace")
        names = [*EXCLUDED_NAMES, *(n.rstrip("/") for n in exclude_paths)]
        listed = list_tree(spark, root, names, max_depth).where(wanted(F.col("path"), root, exclude_paths, max_depth))
        if max_bytes is not None:
            listed = listed.where(F.col("length") <= max_bytes)
        return select_text(read_files(listed), root, exclude_paths, max_depth)
    hidden_dirs, hidden_files = _hidden_entries(spark, root, max_depth)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # On the file's metadata alone, so that Spark drops the files before any task opens them.
    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = reader.load([root, *hidden_dirs]).where(wanted(listed, root, exclude_paths, max_depth))
    files = files.select("path", "length", "content")
    if hidden_files:
        rest = spark.createDataFrame(list(hidden_files), "path string, length long")
        files = files.unionByName(_read_each(rest.where(wanted(F.col("path"), root, exclude_paths, max_depth))))
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return select_text(files, root, exclude_paths, max_depth)


def wanted(path: Column, root: str, exclude_paths: Sequence[str] = (), max_depth: int | None = None) -> Column:
    """The path rules of a scan over a full path."""
    rel = relative_to(F.regexp_replace(path, r"^file:/+", "/"), reported_root(root))
    return is_scannable(rel, exclude_paths, max_depth) & ~is_excluded(rel, exclude_paths)


def _hidden_entries(spark: SparkSession, root: str, max_depth: int | None) -> tuple[list[str], list[tuple[str, int]]]:
    """Directories, and files with their sizes, that Spark's listing leaves out.

    Names and sizes only, as in Spark's own listing; no content reaches the driver.
    """
    fs_root = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(fs_root).toString().rstrip("/")
    dirs, files = [], []
    for depth in count() if max_depth is None else range(max_depth):
        if depth and not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base + "/*" * depth)):
            break
        pattern = spark._jvm.org.apache.hadoop.fs.Path(base + "/*" * depth + "/{.,_}*")
        for status in fs.globStatus(pattern) or []:
            path = status.getPath().toString()
            if set(path[len(base):].split("/")) & set(EXCLUDED_NAMES):
                continue
            if status.isDirectory():
                dirs.append(path)
            else:
                files.append((path, status.getLen()))
    return dirs, files


def _read_each(listed: DataFrame) -> DataFrame:
    """(path, length, content) of single files, read inside the tasks."""

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            # One file at a time, so that a batch never holds many contents.
            for row in batch.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", row.path))
                with store.open_input_stream(path) as stream:
                    yield pd.DataFrame([(row.path, row.length, stream.read())], columns=["path", "length", "content"])

    return listed.repartition("path").mapInPandas(contents, "path string, length long, content binary")


def select_text(
    files: DataFrame, root: str, exclude_paths: Sequence[str] = (), max_depth: int | None = None
) -> DataFrame:
    """Path rules, then decoding, over a table of the binaryFile schema."""
    rel = relative_to(F.regexp_replace("path", r"^file:/+", "/"), reported_root(root))
    kept = (
        computed_once(files.withColumn("file", rel), "file")
        .where(is_scannable(F.col("file"), exclude_paths, max_depth))
        .where(~is_excluded(F.col("file"), exclude_paths))
    )
    return computed_once(kept.select("file", decode(F.col("content")).alias("text")), "text")


def reported_root(root: str) -> str:
    """The root in the form the reader reports paths in."""
    return "/" + root.removeprefix("file:").lstrip("/") if "://" not in root or root.startswith("file:") else root


def drop_excluded(files: DataFrame, exclude_paths: Iterable[str], root: str | None = None) -> DataFrame:
    """Rows whose path no exclude entry covers; apply before scanning."""
    rel = relative_to(F.col("file"), root) if root else F.col("file")
    return files.where(~is_excluded(rel, exclude_paths))


def drop_ignored(files: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """Rows not listed in an (file) table of version-control-ignored paths."""
    return files.join(ignored_paths.select("file").distinct(), "file", "left_anti")
