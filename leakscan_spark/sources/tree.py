"""Directory trees listed and read inside tasks.

Folders are the rows that spread: a task walks the folders dealt to it, breadth
first, until it has met its share of entries, and hands folders it has not
entered back as rows of the next round. Shares grow from round to round, so
rounds stay few however large the tree is, and the driver sees none of its names.

Links are passed over, and so are folders that may not be read or are gone.
Names that are not UTF-8 show replacement characters in ``path``; ``place``
keeps the bytes that open the file.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SHARE = 10_000  # entries a task meets in the first round before it hands folders on
GROWTH = 4  # of the share, from round to round
READ_BYTES = 8 << 20  # contents that travel in one batch; a larger file is a batch of its own

LISTED = "path string, place binary, length long, modified long"
_WALKED = pa.schema([
    ("path", pa.string()), ("place", pa.binary()), ("length", pa.int64()), ("modified", pa.int64()),
    ("depth", pa.int32()), ("folder", pa.bool_()),
])
_WALKED_SQL = f"{LISTED}, depth int, folder boolean"


def local_folder(root: str) -> bytes | None:
    """The absolute path of a mounted folder, or None for other stores, single files and globs."""
    if "://" in root and not root.startswith("file:"):
        return None
    path = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else os.path.abspath(root)
    return os.fsencode(path) if os.path.isdir(path) else None


def entries(folder: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
    """(path, length, modified in ns, is a folder) of the files and folders right inside one folder."""
    try:
        with os.scandir(folder) as held:
            for entry in held:
                try:
                    inner = entry.is_dir(follow_symlinks=False)
                    if inner or entry.is_file(follow_symlinks=False):
                        info = entry.stat(follow_symlinks=False)
                        yield entry.path, 0 if inner else info.st_size, info.st_mtime_ns, inner
                except FileNotFoundError:  # gone since the folder was opened
                    continue
    except (PermissionError, FileNotFoundError, NotADirectoryError):
        return


def walk(
    start: Iterator[tuple[bytes, int]], skip: Collection[bytes], max_depth: int | None, share: int
) -> Iterator[tuple[bytes, int, int, int, bool]]:
    """(path, length, modified, depth, folder): files below ``start``, and folders left to others."""
    met = 0
    for first in start:
        open_folders = deque([first])
        while open_folders:
            folder, depth = open_folders.popleft()
            if max_depth is not None and depth >= max_depth:
                continue
            if met >= share:
                yield folder, 0, 0, depth, True
                continue
            for path, length, modified, inner in entries(folder):
                met += 1
                if path.rsplit(b"/", 1)[-1] in skip:
                    continue
                if not inner:
                    yield path, length, modified, depth, False
                elif met < share:
                    open_folders.append((path, depth + 1))
                else:
                    yield path, 0, 0, depth + 1, True


def list_tree(
    spark: SparkSession,
    root: str,
    skip: Collection[str] = (),
    max_depth: int | None = None,
    share: int = SHARE,
) -> DataFrame:
    """(path, place, length, modified) of the files below a mounted folder, which every executor must see.

    Entries named in ``skip`` are passed over, and such folders never entered.
    A file right below the root has depth one. The listing lies below ``spark.checkpoint.dir``.
    """
    base = local_folder(root)
    if base is None:
        raise NotADirectoryError(root)
    names = frozenset(os.fsencode(n) for n in skip)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = shared_dir(spark, "listing")
    folders = spark.createDataFrame([(bytearray(base), 0)], "place binary, depth int").coalesce(1)
    rounds = 0
    while True:
        folders.mapInArrow(_walker(names, max_depth, share), _WALKED_SQL).write.parquet(f"{out}/round={rounds}")
        left = spark.read.schema(_WALKED_SQL).parquet(f"{out}/round={rounds}").where("folder")
        if left.isEmpty():
            break
        folders = left.select("place", "depth").repartition(tasks)
        rounds, share = rounds + 1, share * GROWTH
    found = spark.read.schema(f"{_WALKED_SQL}, round int").parquet(out)
    return found.where(~F.col("folder")).select("path", "place", "length", "modified")


def _walker(skip: Collection[bytes], max_depth: int | None, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                yield from zip(batch["place"].to_pylist(), batch["depth"].to_pylist(), strict=True)

        rows: list[tuple] = []
        for place, length, modified, depth, folder in walk(dealt(), skip, max_depth, share):
            rows.append((place.decode("utf-8", "replace"), place, length, modified, depth, folder))
            if len(rows) == 10_000:
                yield _batch(rows, _WALKED)
                rows = []
        if rows:
            yield _batch(rows, _WALKED)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_READ = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def read_files(listed: DataFrame) -> DataFrame:
    """(path, length, content) of listed files; one that is gone or may not be read gives no row."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, place in zip(batch["path"].to_pylist(), batch["place"].to_pylist(), strict=True):
                try:
                    with open(place, "rb") as file:
                        content = file.read()
                except (PermissionError, FileNotFoundError):
                    continue
                rows.append((path, len(content), content))
                size += len(content)
                if size >= READ_BYTES:
                    yield _batch(rows, _READ)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _READ)

    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Listings keep a folder's files together; reading spreads them.
    spread = listed.select("path", "place").repartition(tasks, "place")
    return spread.mapInArrow(contents, "path string, length long, content binary")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, place, length, modified, change) between two listings: created, edited or deleted."""
    kept = ["path", "place", "length", "modified"]
    old = before.select("place", F.struct(*kept).alias("old"))
    new = now.select("place", F.struct(*kept).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted")
        .when((F.col("old.length") != F.col("new.length")) | (F.col("old.modified") != F.col("new.modified")), "edited")
    )
    both = old.join(new, "place", "full").withColumn("change", change).where(F.col("change").isNotNull())
    return both.select(F.coalesce("new", "old").alias("file"), "change").select("file.*", "change")
