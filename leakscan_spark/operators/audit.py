"""Audit logs: chain verification, pruning, queries, events and excerpts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rank
from ..functions.redaction import redact_text
from ..functions.rules import BUILTIN_RULES
from ..sources.audit import is_blank

# Lines per block when neighbours are looked up: no sort group grows beyond it.
BLOCK_LINES = 100_000


def line_hash(raw: Column) -> Column:
    """What the next entry's prevHash must be."""
    return F.sha2(F.concat(raw, F.lit("\n")), 256)


def with_previous(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Non-blank lines with ``previous``, the non-blank line before each in its log.

    A log may hold a third of all rows, so it is not sorted as one group: lag
    runs inside blocks of line numbers, and the first line of each block takes
    the last line of the block before from a table with one row per block.
    """
    rows = lines.where(~is_blank(F.col("raw"))).withColumn(
        "block", F.floor((F.col("line_no") - 1) / block_lines)
    )
    inside = Window.partitionBy("log_id", "block").orderBy("line_no")
    lagged = rows.withColumn("inner_previous", F.lag("raw").over(inside))
    tails = rows.groupBy("log_id", "block").agg(F.max_by("raw", "line_no").alias("tail"))
    across = Window.partitionBy("log_id").orderBy("block")
    heads = tails.select("log_id", "block", F.lag("tail").over(across).alias("before"))
    return (
        lagged.join(heads, ["log_id", "block"])
        .withColumn("previous", F.coalesce("inner_previous", "before"))
        .drop("block", "inner_previous", "before")
    )


def verify_chain(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(log_id, line_no, reason) of every break in the hash chain."""
    rows = with_previous(lines, block_lines)
    return _breaks(rows, line_hash(F.col("previous")))


def _breaks(rows: DataFrame, expected: Column) -> DataFrame:
    actual = F.get_json_object("raw", "$.prevHash")
    reason = (
        F.when(F.try_parse_json("raw").isNull(), "malformed JSON")
        .when(actual.eqNullSafe(expected), F.lit(None))
        .when(expected.isNull(), F.concat(F.lit("first entry has prevHash "), actual, F.lit(" but expected null")))
        .otherwise(
            F.concat(
                F.lit("prevHash "), F.coalesce(F.concat(F.lit("'"), actual, F.lit("'")), F.lit("None")),
                F.lit(" does not match expected "), expected,
            )
        )
    )
    return rows.select("log_id", "line_no", reason.alias("reason")).where(F.col("reason").isNotNull())


MARKS = "log_id string, mark_line long, mark_hash string"


def log_marks(lines: DataFrame) -> DataFrame:
    """(log_id, mark_line, mark_hash): the last non-blank line of each log and its hash."""
    last = F.max_by(F.struct("line_no", "raw"), "line_no").alias("last")
    tips = lines.where(~is_blank(F.col("raw"))).groupBy("log_id").agg(last)
    return tips.select(
        "log_id", F.col("last.line_no").cast("long").alias("mark_line"), line_hash(F.col("last.raw")).alias("mark_hash")
    )


def unverified(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines behind the mark of their log, with its ``mark_hash``; all lines of a log without one."""
    met = lines.join(marks, "log_id", "left")
    return met.where(F.col("line_no") > F.coalesce("mark_line", F.lit(-1))).drop("mark_line")


def verify_since(lines: DataFrame, marks: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Breaks behind the marks of an earlier verification, whose lines are not hashed again.

    The first new line of a log must name the hash that its mark holds.
    """
    rows = with_previous(unverified(lines, marks), block_lines)
    return _breaks(rows, F.coalesce(line_hash(F.col("previous")), F.col("mark_hash")))


def lost_marks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """(log_id, line_no, reason) of marks whose line is gone or no longer has its hash.

    Meets one line per log. An edit further back shows in ``verify_chain``, which reads all lines.
    """
    at = lines.where(~is_blank(F.col("raw"))).select(
        "log_id", F.col("line_no").cast("long").alias("mark_line"), line_hash(F.col("raw")).alias("found")
    )
    reason = F.when(F.col("found").isNull(), "truncated: the last verified line is gone").when(
        F.col("found") != F.col("mark_hash"), "rewritten: the last verified line has changed"
    )
    rows = marks.join(at, ["log_id", "mark_line"], "left").select(
        "log_id", F.col("mark_line").alias("line_no"), reason.alias("reason")
    )
    return rows.where(F.col("reason").isNotNull())


def advanced_marks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` moved to the ends of logs that have grown. A truncated log keeps its mark, and so its verdict."""
    fresh = log_marks(unverified(lines, marks).drop("mark_hash"))
    return fresh.unionByName(marks.join(fresh, "log_id", "left_anti"))


def resume_verification(lines: DataFrame, path: str) -> DataFrame:
    """Verify what was appended since the last run at ``path``: (log_id, line_no, reason).

    Runs are numbered. Marks of a run are written last, beside those of the run
    before, so a run that fails is repeated from the same marks.
    """
    spark = lines.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks/run=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    run = max([int(x.getPath().getParent().getName().removeprefix("run=")) for x in found], default=-1)
    marks = spark.createDataFrame([], MARKS) if run < 0 else spark.read.schema(MARKS).parquet(f"{path}/marks/run={run}")
    breaks = verify_since(lines, marks).select("log_id", F.col("line_no").cast("long").alias("line_no"), "reason")
    breaks.unionByName(lost_marks(lines, marks)).write.mode("overwrite").parquet(f"{path}/breaks/run={run + 1}")
    advanced_marks(lines, marks).write.mode("overwrite").parquet(f"{path}/marks/run={run + 1}")
    return spark.read.parquet(f"{path}/breaks/run={run + 1}")


def tip_hash(lines: DataFrame) -> DataFrame:
    """Hash of each log's last non-blank line."""
    return (
        lines.where(~is_blank(F.col("raw"))).groupBy("log_id")
        .agg(F.max_by("raw", "line_no").alias("tip")).select("log_id", line_hash(F.col("tip")).alias("tip_hash"))
    )


def _entry_time(raw: Column) -> Column:
    return F.try_to_timestamp(F.get_json_object(raw, "$.timestamp"))


def is_retained(raw: Column, cutoff: Column) -> Column:
    """Whether an entry parses and is not older than the cutoff."""
    return F.coalesce(F.try_parse_json(raw).isNotNull() & (_entry_time(raw) >= cutoff), F.lit(False))


def prune_and_reseal(lines: DataFrame, cutoff: Column) -> DataFrame:
    """Retained entries (log_id, line_no, raw) with prevHash rewritten in order.

    Each hash covers the line before it, rewritten itself, so one log can only be
    resealed front to back. Logs spread over the cluster; within a task the rows
    stream by in sorted order and only the last hash is held.
    """
    kept = (
        lines.where(is_retained(F.col("raw"), cutoff)).select("log_id", "line_no", "raw")
        .repartition("log_id").sortWithinPartitions("log_id", "line_no")
    )

    def reseal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, tip = None, None
        for batch in batches:
            sealed = []
            for log_id, raw in zip(batch["log_id"], batch["raw"]):
                if log_id != log:
                    log, tip = log_id, None
                line = json.dumps({**json.loads(raw), "prevHash": tip})
                tip = hashlib.sha256((line + "\n").encode()).hexdigest()
                sealed.append(line)
            yield batch.assign(raw=sealed)

    return kept.mapInPandas(reseal, kept.schema)


def retention_manifest(lines: DataFrame, cutoff: Column, days: int) -> DataFrame:
    """Per log: pruned and retained counts and the tip hash before pruning."""
    rows = lines.where(~is_blank(F.col("raw")))
    keep = is_retained(F.col("raw"), cutoff)
    return (
        rows.groupBy("log_id")
        .agg(
            F.count_if(~keep).alias("pruned"), F.count_if(keep).alias("retained"),
            F.max_by("raw", "line_no").alias("tip"),
        )
        .select(
            "log_id", "pruned", "retained", F.lit(days).alias("retention_days"),
            line_hash(F.col("tip")).alias("pre_tip_hash"),
        )
        .where(F.col("pruned") > 0)
    )


def query_log(
    entries: DataFrame,
    event_type: str | None = None,
    agent_type: str | None = None,
    since: datetime | str | None = None,
    cwd: str | None = None,
    git_repo: str | None = None,
    limit: int | None = None,
    order: tuple[str, ...] = ("line_no",),
) -> DataFrame:
    """Filter parsed entries, then the last ``limit`` of them in log order."""
    e = entries
    if event_type:
        e = e.where(F.col("entry.eventType") == event_type)
    if agent_type:
        e = e.where(F.col("entry.agentType") == agent_type)
    if since:
        e = e.where(F.try_to_timestamp("entry.timestamp") >= F.lit(since).cast("timestamp"))
    if cwd:
        e = e.where(F.col("entry.cwd").contains(cwd))
    if git_repo:
        e = e.where(F.col("entry.gitRepo").contains(git_repo))
    if limit:
        e = e.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return e.orderBy(*order)


def alerts(entries: DataFrame, min_risk: str = "high", product: str = "leakscan") -> DataFrame:
    """Notification payloads of entries at or above a risk."""
    e = F.col("entry")
    risk = F.coalesce(e["action"]["riskLevel"], F.lit("low"))
    event = F.coalesce(e["eventType"], F.lit("unknown"))
    command = e["action"]["command"]
    # An unknown entry risk ranks lowest, an unknown threshold ranks as high.
    floor = {"low": 1, "medium": 2, "high": 3, "critical": 4}.get(min_risk, 3)
    text = F.concat(
        F.lit(f"[{product}] "), risk, F.lit("-risk event: "), event,
        F.when(F.coalesce(command, F.lit("")) != "", F.concat(F.lit(" — "), command)).otherwise(""),
    )
    keys = [c for c in entries.columns if c not in ("raw", "entry")]
    return entries.where(F.greatest(rank(risk), F.lit(1)) >= floor).select(
        *keys, event.alias("event"), risk.alias("risk"), command.alias("command"),
        e["timestamp"].alias("timestamp"), e["agentType"].alias("agent"), text.alias("text"),
    )


def _entry(**fields) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items() if v is not None])


def command_event(
    command: str, risk: Column, passed: Column, action: Column, reason: Column, agent: Column
) -> Column:
    """Event struct for a judged command: text redacted, risk of the raw command."""
    return _entry(
        eventType=F.lit("command_intercepted"), agentType=agent,
        action=_entry(command=redact_text(command, list(enumerate(BUILTIN_RULES))), riskLevel=risk),
        securityCheck=_entry(passed=passed, reason=reason),
        resolution=_entry(actionTaken=action),
    )


def secret_event(file: Column, rule: Column, action: Column, agent: Column | None = None) -> Column:
    """Event struct for a detected secret; always critical."""
    return _entry(
        eventType=F.lit("secret_detected"),
        agentType=F.lit(None).cast("string") if agent is None else agent,
        action=_entry(riskLevel=F.lit("critical")),
        securityCheck=_entry(passed=F.lit(False), reason=F.concat(rule, F.lit(" detected in "), file)),
        resolution=_entry(actionTaken=action),
    )


def sanitised_event(content_type: Column, matched: Column, agent: Column | None = None) -> Column:
    """Event struct for redacted tool output."""
    return _entry(
        eventType=F.lit("content_sanitized"),
        agentType=F.lit(None).cast("string") if agent is None else agent,
        securityCheck=_entry(
            passed=F.lit(False),
            reason=F.concat(matched.cast("string"), F.lit(" sensitive patterns detected")),
            details=_entry(contentType=content_type, patternsMatched=matched),
        ),
        resolution=_entry(actionTaken=F.lit("redacted")),
    )


SHARE_COMMAND = 60


def share_line(entry: Column) -> Column:
    """One line of a shared excerpt: time, event, risk, detail."""
    suffix = F.concat(F.lit("["), F.coalesce(entry["resolution"]["actionTaken"], F.lit("unknown")), F.lit("]"))
    command = entry["action"]["command"]
    short = F.when(F.length(command) <= SHARE_COMMAND, command).otherwise(
        F.concat(F.left(command, F.lit(SHARE_COMMAND)), F.lit("..."))
    )
    reason = F.coalesce(entry["securityCheck"]["reason"], F.lit(""))
    detail = (
        F.when(entry["eventType"] == "secret_detected", F.concat(reason, F.lit(" "), suffix))
        .when(F.coalesce(command, F.lit("")) != "", F.concat(short, F.lit(" "), suffix))
        .when(reason != "", F.concat(reason, F.lit(" "), suffix))
        .otherwise(suffix)
    )
    time = F.coalesce(
        F.date_format(F.try_to_timestamp(entry["timestamp"]), "yyyy-MM-dd'T'HH:mm:ss.'000Z'"),
        entry["timestamp"], F.lit(""),
    )

    def padded(text: Column, width: int) -> Column:
        return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))

    event = padded(F.coalesce(entry["eventType"], F.lit("unknown")), 20)
    risk = padded(F.upper(F.coalesce(entry["action"]["riskLevel"], F.lit("low"))), 8)
    return F.concat(F.lit("  "), time, F.lit("  "), event, F.lit("  "), risk, F.lit(" "), detail)


def policy_hash(patterns: Column) -> Column:
    """First 16 hex digits of sha256 over the sorted patterns as a JSON array."""
    # to_json leaves no space after commas; the hashed form has one.
    quoted = F.transform(
        F.array_sort(patterns), lambda p: F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", "")
    )
    text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.left(F.sha2(text, 256), F.lit(16))
