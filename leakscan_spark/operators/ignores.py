"""Ignore files: which paths of a tree they leave out, with nested files, negation and ignored folders.

Every folder and file is a node. A node meets the lines of the ignore files in
the folders above it by equality; the last matching line of the deepest file
decides. A path is out if it or any folder above it is ignored, so nothing below
an ignored folder can come back. Verdicts on folders are worked out once per
distinct folder. The lines of one ignore file stay together as one array.

Sets and question marks stand for one character, where git takes one byte.
Lines for a whole tree from elsewhere (a shared list, settings) go to the top
folder with line numbers below those of its own file.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ignore_patterns import ignore_pattern
from ..functions.paths import basename

IGNORE_FILE = ".gitignore"


def parent(path: Column) -> Column:
    """The folder of a path without a leading slash; empty at the top."""
    return F.regexp_replace(path, r"(?s)(?:^|/)[^/]*\z", "")


def folders_above(path: Column) -> Column:
    """All folders that hold a path, the top (empty) one first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignore_lines(files: DataFrame, tree: Sequence[str] = (), name: str = IGNORE_FILE) -> DataFrame:
    """(tree..., folder, line_no, pattern) from the ignore files of a (tree..., file, text) table."""
    own = files.where(basename(F.col("file")) == name)
    return own.select(
        *tree, parent(F.col("file")).alias("folder"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "pattern")
    )


def _compiled(lines: DataFrame, tree: Sequence[str]) -> DataFrame:
    """(tree..., folder, patterns): the patterns of each folder's file, the last line first."""

    @F.pandas_udf("struct<regex:string,negated:boolean,folders_only:boolean,on_name:boolean>")
    def read(patterns: pd.Series) -> pd.DataFrame:
        found = [ignore_pattern(p) if p is not None else None for p in patterns]
        none = (None, None, None, None)
        return pd.DataFrame([tuple(p) if p else none for p in found], columns=["regex", "negated", "folders_only", "on_name"])

    rows = lines.select(*tree, "folder", "line_no", read("pattern").alias("p")).where("p.regex is not null")
    listed = F.sort_array(F.collect_list(F.struct("line_no", "p")), asc=False)
    return rows.groupBy(*tree, "folder").agg(F.transform(listed, lambda x: x["p"]).alias("patterns"))


def _ignored(nodes: DataFrame, compiled: DataFrame, tree: Sequence[str], folders: bool) -> DataFrame:
    """(tree..., node) of the nodes whose deciding line ignores them."""
    pairs = nodes.select(*tree, "node", F.explode(folders_above(F.col("node"))).alias("folder"))
    node = F.col("node")
    below = F.when(F.col("folder") == "", node).otherwise(F.substring(node, F.length("folder") + 2, F.length(node)))

    def hit(p: Column) -> Column:
        matched = F.when(p["on_name"], F.regexp_like(basename(node), p["regex"])).otherwise(F.regexp_like(F.col("below"), p["regex"]))
        return matched if folders else ~p["folders_only"] & matched

    met = pairs.join(compiled, [*tree, "folder"]).withColumn("below", below)
    first = F.get(F.filter("patterns", hit), 0)["negated"].alias("negated")
    decided = met.select(*tree, "node", F.length("folder").alias("depth"), first).where("negated is not null")
    last = decided.groupBy(*tree, "node").agg(F.max(F.struct("depth", "negated")).alias("last"))
    return last.where("not last.negated").select(*tree, "node")


def ignored_paths(files: DataFrame, lines: DataFrame, tree: Sequence[str] = ()) -> DataFrame:
    """(tree..., file) of the distinct files that the ignore ``lines`` leave out.

    ``files`` has (tree..., file), paths below the top of their tree, and
    ``lines`` (tree..., folder, line_no, pattern). ``tree`` names columns that
    tell trees apart, such as a repository.
    """
    compiled = _compiled(lines, tree)
    paths = files.where(F.col("file").isNotNull()).select(*tree, F.col("file").alias("node")).distinct()
    folders = paths.select(*tree, parent(F.col("node")).alias("node")).distinct()
    folders = folders.select(*tree, F.explode(folders_above(F.concat("node", F.lit("/")))).alias("node")).where("node <> ''").distinct()
    gone = _ignored(folders, compiled, tree, folders=True)
    # Folders at or below an ignored one.
    below = folders.select(*tree, F.col("node").alias("under"), F.explode(folders_above(F.concat("node", F.lit("/")))).alias("node"))
    under = below.join(gone, [*tree, "node"]).select(*tree, F.col("under").alias("folder")).distinct()
    placed = paths.withColumn("folder", parent(F.col("node")))
    inside = placed.join(under, [*tree, "folder"], "left_semi").select(*tree, "node")
    own = _ignored(placed.join(under, [*tree, "folder"], "left_anti").select(*tree, "node"), compiled, tree, folders=False)
    return inside.unionByName(own).withColumnRenamed("node", "file")


def drop_ignored_by(files: DataFrame, lines: DataFrame, tree: Sequence[str] = ()) -> DataFrame:
    """The rows of ``files`` that the ignore ``lines`` leave in; rows without a path stay."""
    return files.join(ignored_paths(files, lines, tree), [*tree, "file"], "left_anti")
