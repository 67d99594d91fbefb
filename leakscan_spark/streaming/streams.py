"""Structured Streaming jobs: continuous scan, gates, redaction, alerts, chained logs.

Each job is the batch expression over a streaming source. Only the chained log
keeps state: the tip hash of each log.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import BUILTIN_RULES, Rule
from ..operators.audit import secret_event
from ..operators.triage import mark_suppressed
from ..session import shared_dir
from ..sources.corpus import BINARY_FILE_SCHEMA, decode
from ..sources.suppressions import Suppression
from ..sources.tree import LISTED, changed, list_tree, read_files

# Names whose changes are not watched, and what is inside them.
UNWATCHED = (".git", "node_modules", ".hg", "__pycache__", ".tox", ".venv")


def is_watched(path: Column) -> Column:
    return ~F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*[F.lit(n) for n in UNWATCHED]))


def watch_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """New files below a directory as (file, text). Spark sees files once; ``watch_tree``
    also sees edits in place and deletions."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", True).options(**options).load(root)
    )
    return files.where(is_watched(F.col("path"))).select(
        F.col("path").alias("file"), decode(F.col("content")).alias("text")
    )


def watch_table(spark: SparkSession, directory: str, table: str, schema) -> DataFrame:
    """New Parquet files of one table, a folder of files or a single one, as a stream."""
    path = f"{directory.rstrip('/')}/{table}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A stream reads folders; a table of one file is the only file of its name in its folder.
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def run_to_end(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off everything available now, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch under its number, so that a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def scan_stream(
    files: DataFrame,
    out: str,
    checkpoint: str,
    rules: Sequence[Rule] = BUILTIN_RULES,
    suppressions: Sequence[Suppression] = (),
    scan: Callable[[DataFrame, Sequence[Rule]], DataFrame] | None = None,
) -> None:
    """Findings of every new file, split by suppression, and one audit event per raw finding."""
    run_to_end(files, scan_into(out, rules, suppressions, scan), checkpoint)


def scan_into(
    out: str,
    rules: Sequence[Rule] = BUILTIN_RULES,
    suppressions: Sequence[Suppression] = (),
    scan: Callable[[DataFrame, Sequence[Rule]], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch of (file, text): its findings and audit events below ``out``."""
    from ..operators.scan import scan_files

    scan = scan or scan_files

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = scan(batch, rules).drop("match")
        marked = mark_suppressed(found, list(suppressions))
        # The findings of a batch are few; they are written once and read twice.
        replace_batch(marked, f"{out}/marked", batch_id)
        stored = batch.sparkSession.read.parquet(f"{out}/marked/batch={batch_id}")
        replace_batch(stored.where("suppressed_by is null").drop("suppressed_by"), f"{out}/findings", batch_id)
        event = secret_event(F.col("file"), F.col("rule"), F.lit("allowed"))
        replace_batch(stored.select(event.alias("e")).select("e.*"), f"{out}/audit", batch_id)

    return handle


def watch_tree(
    spark: SparkSession,
    root: str,
    handle: Callable[[DataFrame, int], None],
    state: str,
    interval: str | None = None,
):
    """Every created or edited file below a mounted folder, as (file, text) batches for ``handle``.

    A heartbeat stream lists the tree in tasks and compares it with the listing
    of the beat before, by size and time of change. Listings are numbered by
    beat and lie below ``state`` with the checkpoint, so a repeated beat starts
    from the same earlier listing and a restart goes on where the last one
    ended; ``handle`` replaces what it wrote for that number. Deletions are in
    ``state``/changes with all others. Without ``interval`` one beat runs.
    """
    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = beats.writeStream.option("checkpointLocation", f"{state}/checkpoint")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)

    def beat(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        now_path = f"{state}/listings/{n}"
        list_tree(session, root, UNWATCHED).write.mode("overwrite").parquet(now_path)
        now = session.read.schema(LISTED).parquet(now_path)
        before = session.read.schema(LISTED).parquet(f"{state}/listings/{n - 1}") if n else now.limit(0)
        replace_batch(changed(before, now), f"{state}/changes", n)
        changes = session.read.parquet(f"{state}/changes/batch={n}")
        fresh = changes.where((F.col("change") != "deleted") & is_watched(F.col("path")))
        files = read_files(fresh).select(F.col("path").alias("file"), decode(F.col("content")).alias("text"))
        if not fresh.isEmpty():
            handle(files, n)
        # A beat looks back one listing only.
        old = session._jvm.org.apache.hadoop.fs.Path(f"{state}/listings/{n - 2}")
        old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    query = writer.foreachBatch(beat).start()
    if not interval:
        query.awaitTermination()
    return query


def transform_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """A stateless batch operator over a stream (gates, redaction, alerts)."""
    run_to_end(stream, lambda batch, n: replace_batch(transform(batch), out, n), checkpoint)


CHAINED_SCHEMA = "log_id string, seq long, raw string"


def _chain(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tip, seq = state.get if state.exists else (None, 0)
    # The rows of one micro-batch may come in any order; their number decides.
    batch = pd.concat(list(rows)).sort_values("ord")
    lines = []
    for event in batch["event"]:
        line = json.dumps({**json.loads(event), "prevHash": tip})
        tip = hashlib.sha256((line + "\n").encode()).hexdigest()
        seq += 1
        lines.append((key[0], seq, line))
    state.update((tip, seq))
    yield pd.DataFrame(lines, columns=["log_id", "seq", "raw"])


def chain_events(events: DataFrame) -> DataFrame:
    """(log_id, ord, event JSON) as chained log lines; the state is each log's tip.

    One trigger's rows of one log are held together to be put in order, so bound
    a trigger with the source's maxFilesPerTrigger or maxBytesPerTrigger.
    """
    return events.groupBy("log_id").applyInPandasWithState(
        _chain, CHAINED_SCHEMA, "tip string, seq long", "append", GroupStateTimeout.NoTimeout
    )


def append_chain(events: DataFrame, out: str, checkpoint: str) -> None:
    """Write chained lines exactly once to a Parquet log."""
    query = (
        chain_events(events).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output, checkpoint) folders below the shared folder."""
    base = shared_dir(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
