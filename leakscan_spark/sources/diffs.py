"""Unified diffs: added lines with their line numbers in the new file.

Each patch is cut into file regions, hunks and lines inside its own row, so the
new-file line number of an added line is the hunk start plus its place among
the hunk's added and context lines. No window and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import computed_once

# Where a new file region and where a hunk starts.
REGION = r"(?dm)^(?=diff --git |Binary files .* differ$)"
HUNK = r"(?dm)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
# The path after the last "+++" line of a region's header.
TARGET = r"(?s)^(?:.*\n)?\+\+\+ ([^\n]*)"
HUNK_START = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def _pieces(text: Column, boundary: str) -> Column:
    # The JVM's split never yields an empty first piece for a zero-width match
    # at the start; a leading line end makes both cases look the same.
    return F.split(F.concat(F.lit("\n"), text), boundary, -1)


def added_lines(patches: DataFrame, keep: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """(keep..., file, line, text) of every added line of a (keep..., patch) table."""
    text = F.replace(F.col("patch"), F.lit("\r\n"), F.lit("\n"))
    regions = patches.select(*keep, F.explode(_pieces(text, REGION)).alias("region"))
    cut = computed_once(regions.select(*keep, _pieces(F.col("region"), HUNK).alias("cut")), "cut")
    target = F.regexp_extract(F.col("cut")[0], TARGET, 1)
    headed = computed_once(
        cut.where(F.size("cut") > 1).select(*keep, "cut", F.trim(target, F.lit(" \t\r\f\v")).alias("target")), "target"
    )
    # No target, or a deletion: nothing was added.
    hunks = headed.where(~F.col("target").isin("", "/dev/null")).select(
        *keep,
        F.regexp_replace(F.translate("target", "\\", "/"), "^[ab]/", "").alias("file"),
        F.explode(F.slice("cut", 2, F.size("cut"))).alias("hunk"),
    ).where(F.col("file") != "")
    body = F.filter(F.split("hunk", "\n"), lambda r: r.startswith("+") | r.startswith(" "))
    rows = hunks.select(
        *keep, "file",
        F.regexp_extract("hunk", HUNK_START, 1).cast("bigint").alias("start"),
        F.posexplode(body).alias("n", "row"),
    )
    found = rows.where((F.col("start") > 0) & F.col("row").startswith("+")).select(
        *keep, "file", (F.col("start") + F.col("n")).cast("int").alias("line"),
        F.substr("row", F.lit(2)).alias("text"),
    )
    return computed_once(found, "text")
