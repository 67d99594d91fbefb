"""Findings in and out: JSON rows, SARIF rows, CSV, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

NOTE = (
    "Pattern-based scan without triage: findings have not been judged in context. "
    "Look into each one before acting on it."
)
# Findings of this many consecutive lines share one JSON row, so that a file
# with very many findings becomes several rows instead of one huge one.
LINES_PER_ROW = 50_000

RESULT_SCHEMA = (
    "file string, matches array<struct<pattern: struct<name: string, severity: string, "
    "description: string>, line: int, column: int, redacted: string, engines: array<string>>>"
)


def json_results(findings: DataFrame, lines_per_row: int = LINES_PER_ROW) -> DataFrame:
    """(file, part, matches) rows; the matched text itself never leaves.

    Small files are one row with part 0; readers concatenate parts in order.
    """
    part = F.floor(F.coalesce("line", F.lit(0)) / lines_per_row).cast("int")
    return _results(findings.withColumn("part", part))


def _results(findings: DataFrame) -> DataFrame:
    """(file, part, matches) of findings that have a ``part``."""
    engines = F.col("engines") if "engines" in findings.columns else F.lit(None).cast("array<string>")
    match = F.struct(
        F.col("line"), F.col("column"), F.coalesce("rule_ord", F.lit(-1)).alias("rule_ord"),
        F.struct("rule", "severity", F.coalesce("description", F.lit("")).alias("description")).alias("p"),
        F.col("redacted"), engines.alias("engines"),
    )
    grouped = findings.groupBy("file", "part").agg(F.array_sort(F.collect_list(match)).alias("m"))
    return grouped.select(
        "file", "part",
        F.transform(
            "m",
            lambda x: F.struct(
                F.struct(
                    x["p"]["rule"].alias("name"), x["p"]["severity"].alias("severity"),
                    x["p"]["description"].alias("description"),
                ).alias("pattern"),
                x["line"].alias("line"), x["column"].alias("column"),
                x["redacted"].alias("redacted"), x["engines"].alias("engines"),
            ),
        ).alias("matches"),
    )


FINDINGS_PER_PART = 10_000
ORDER = ("file", "line", "column", "rule_ord", "rule", "redacted")


def numbered(findings: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Findings with ``n``, their place from 0 in file, line and column order, over all or ``within`` columns of ``ORDER``.

    Ranges of the order are dealt over the cluster, so a file of any number of
    findings, on one line or many, spreads over tasks: places are counted inside
    a range, and the sizes of the ranges before are added from a table of one row
    per range (and file). The scan behind ``findings`` runs once. Places of equal
    findings are interchangeable; absent values come first.
    """
    spark = findings.sparkSession
    base = shared_dir(spark, "numbered")
    findings.write.parquet(f"{base}/found")
    found = spark.read.schema(findings.schema).parquet(f"{base}/found")
    ranged = found.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id())
    ranged.write.parquet(f"{base}/ranged")
    rows = spark.read.schema(ranged.schema).parquet(f"{base}/ranged")
    key = [*within, "range"]
    earlier = Window.partitionBy(*within).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key).agg(F.count("*").alias("size"))
    before = before.select(*key, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*ORDER))
    held = rows.withColumn("place", place).alias("r").join(
        before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    )
    return held.select(*[F.col(f"r.{c}") for c in findings.columns], (F.col("before") + F.col("place") - 1).alias("n"))


def json_parts(findings: DataFrame, most: int = FINDINGS_PER_PART) -> DataFrame:
    """(file, part, matches) rows of at most ``most`` findings; readers concatenate the parts of a file in order."""
    part = F.floor(F.col("n") / most).cast("int")
    return _results(numbered(findings, ("file",)).withColumn("part", part))


def write_json(findings: DataFrame, path: str, suppressed: DataFrame | None = None) -> None:
    """Write results (and suppressed findings) as JSON lines with their envelope."""
    envelope = [
        F.lit(NOTE).alias("_note"), F.lit("local").alias("scan_mode"), F.lit(False).alias("triage_applied"),
    ]
    json_parts(findings).select(*envelope, "*").write.mode("overwrite").json(f"{path}/results")
    if suppressed is not None:
        suppressed.select("file", "line", "column", "rule", "severity", "reason", "source").write.mode(
            "overwrite"
        ).json(f"{path}/suppressed")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings rows of result files, wrapped in ``results`` or as a bare list."""
    rows = spark.read.schema(f"results array<struct<{_fields(RESULT_SCHEMA)}>>, {RESULT_SCHEMA}").option(
        "multiLine", True
    ).json(path)
    return unpack_results(rows)


def unpack_results(rows: DataFrame) -> DataFrame:
    """Long findings of rows that hold ``results``, or (file, matches) themselves."""
    one = F.when(F.col("file").isNotNull(), F.array(F.struct("file", "matches")))
    files = rows.select(F.explode(F.coalesce("results", one)).alias("r"))
    hits = files.select(F.col("r.file").alias("file"), F.explode("r.matches").alias("m"))
    return hits.select(
        "file",
        F.col("m.line").alias("line"),
        F.col("m.column").alias("column"),
        F.coalesce("m.pattern.name", F.lit("unknown")).alias("rule"),
        F.coalesce("m.pattern.severity", F.lit("medium")).alias("severity"),
        F.coalesce("m.pattern.description", F.lit("")).alias("description"),
        F.coalesce("m.redacted", F.lit("")).alias("redacted"),
    )


def _fields(schema: str) -> str:
    """A top-level schema string in the form used inside a struct."""
    name, rest = schema.split(" ", 1)
    return f"{name}: " + rest.replace(", matches array", ", matches: array", 1)


def sarif_id(rule: Column) -> Column:
    return F.regexp_replace(F.lower(rule), r"(?U)[\s\x1c-\x1f]+", "-")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding."""
    return findings.select(
        sarif_id(F.col("rule")).alias("rule_id"),
        F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning").alias("level"),
        F.concat("rule", F.lit(" detected")).alias("message"),
        F.translate("file", "\\", "/").alias("uri"),
        F.when(F.col("line") != 0, F.col("line")).alias("start_line"),
        F.when(F.col("line") != 0, F.when(F.col("column") != 0, F.col("column")).otherwise(1)).alias("start_column"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF rule per id: the one seen first in file, line and column order."""
    name = F.min_by(
        F.struct("rule", "description"),
        F.struct("file", "line", "column", F.coalesce("rule_ord", F.lit(-1)).alias("o")),
    )
    return findings.groupBy(sarif_id(F.col("rule")).alias("rule_id")).agg(name.alias("r")).select(
        "rule_id",
        F.col("r.rule").alias("name"),
        F.when(F.coalesce("r.description", F.lit("")) != "", F.col("r.description"))
        .otherwise(F.col("r.rule")).alias("short_description"),
    )


def write_sarif(findings: DataFrame, path: str, tool: str = "leakscan-spark") -> None:
    """SARIF 2.1.0 objects, one JSON line per result and per rule."""
    region = F.when(
        F.col("start_line").isNotNull(),
        F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")),
    )
    sarif_results(findings).select(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.col("uri").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                    region.alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    ).write.mode("overwrite").json(f"{path}/results")
    sarif_rules(findings).select(
        F.lit(tool).alias("tool"), F.col("rule_id").alias("id"), "name",
        F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
    ).write.mode("overwrite").json(f"{path}/rules")


# What marks a SARIF document.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"


def sarif_documents(findings: DataFrame, most: int = FINDINGS_PER_PART, tool: str = "leakscan-spark") -> DataFrame:
    """(part, document): whole SARIF documents of at most ``most`` results each, in file, line and column order.

    A document has one run. Its rules are those its results name, in order of
    first use and as first described there, and every result carries the index of
    its rule. Without findings there is one document with an empty run.
    """
    c = F.col
    columns = [*findings.columns, "n"]
    rows = numbered(findings).select(*columns, F.floor(c("n") / most).cast("int").alias("part"))
    text = F.when(F.coalesce("description", F.lit("")) != "", c("description")).otherwise(c("rule"))
    rules = rows.groupBy("part", sarif_id(c("rule")).alias("id")).agg(
        F.min(F.struct("n", c("rule").alias("name"), text.alias("text"))).alias("first")
    )
    rules = rules.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("first", "id"))).alias("rules"))
    region = F.when(c("line") != 0, F.struct(
        c("line").alias("startLine"), F.when(c("column") != 0, c("column")).otherwise(1).alias("startColumn")
    ))
    place = F.struct(
        F.struct(F.translate("file", "\\", "/").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
        region.alias("region"),
    )
    result = F.struct(
        "n", sarif_id(c("rule")).alias("id"),
        F.when(c("severity").isin("critical", "high"), "error").otherwise("warning").alias("level"),
        F.struct(F.concat("rule", F.lit(" detected")).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    runs = rows.groupBy("part").agg(F.sort_array(F.collect_list(result)).alias("results")).join(rules, "part")
    ids = F.transform("rules", lambda r: r["id"])
    runs = runs.withColumn("ids", ids).select(
        "part",
        F.transform("rules", lambda r: F.struct(
            r["id"].alias("id"), r["first"]["name"].alias("name"), F.struct(r["first"]["text"].alias("text")).alias("shortDescription"),
        )).alias("rules"),
        F.transform("results", lambda r: F.struct(
            r["id"].alias("ruleId"), (F.array_position("ids", r["id"]) - 1).cast("int").alias("ruleIndex"),
            r["level"].alias("level"), r["message"].alias("message"), r["locations"].alias("locations"),
        )).alias("results"),
    )
    first = findings.sparkSession.range(1).select(c("id").cast("int").alias("part"))
    runs = runs.join(first, "part", "full_outer")
    empty = lambda name: F.coalesce(name, F.array().cast(runs.schema[name].dataType)).alias(name)
    driver = F.struct(F.struct(F.lit(tool).alias("name"), empty("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), empty("results"))
    document = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs")
    )
    return runs.select("part", F.to_json(document).alias("document"))


def write_sarif_documents(
    findings: DataFrame, path: str, most: int = FINDINGS_PER_PART, tool: str = "leakscan-spark"
) -> None:
    """One file ``part=N/...`` per document, each of which a SARIF reader opens by itself."""
    sarif_documents(findings, most, tool).write.mode("overwrite").partitionBy("part").text(path)


# -- baselines ---------------------------------------------------------------


def baseline_entries(findings: DataFrame, added_at: Column) -> DataFrame:
    """Every current finding as a baseline entry; nothing is deduplicated."""
    return findings.select("file", "line", F.col("rule").alias("pattern"), added_at.alias("added_at"))


BASELINE_SCHEMA = "file string, line int, pattern string, added_at timestamp, created timestamp"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a baseline, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    done = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(x.getPath().getParent().getName().removeprefix("version=")) for x in done)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version; none is an empty baseline."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], BASELINE_SCHEMA)
    return spark.read.schema(BASELINE_SCHEMA).parquet(f"{path}/version={versions[-1]}")


def _replace(entries: DataFrame, path: str) -> None:
    """Write a new version beside the one in use, which a failed write leaves as it was."""
    version = max([0, *_versions(entries.sparkSession, path)]) + 1
    entries.write.mode("overwrite").parquet(f"{path}/version={version}")


def _created(spark: SparkSession, path: str):
    """When the baseline at ``path`` was first made, or None."""
    return _stored(spark, path).agg(F.min("created")).first()[0]


def create_baseline(findings: DataFrame, path: str, added_at: Column | None = None) -> None:
    """Replace a baseline with all current findings; the first creation time stays."""
    now = F.current_timestamp() if added_at is None else added_at
    first = F.coalesce(F.lit(_created(findings.sparkSession, path)).cast("timestamp"), now)
    _replace(baseline_entries(findings, now).withColumn("created", first), path)


def add_to_baseline(entries: DataFrame, path: str) -> None:
    """Add (file, line, pattern, added_at) entries as they are."""
    spark = entries.sparkSession
    first = F.coalesce(F.lit(_created(spark, path)).cast("timestamp"), F.col("added_at"))
    _replace(_stored(spark, path).unionByName(entries.withColumn("created", first)), path)


def clear_baseline(spark: SparkSession, path: str) -> None:
    _replace(spark.createDataFrame([], BASELINE_SCHEMA).coalesce(1), path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("created")


def show_baseline(entries: DataFrame) -> DataFrame:
    """Entries per file."""
    return entries.groupBy("file").agg(F.count("*").alias("entries"))


# -- remote vulnerabilities --------------------------------------------------


def vulnerabilities_at(vulnerabilities: DataFrame, level: str) -> DataFrame:
    return vulnerabilities.where(F.col("level") == level)


def vulnerable_files(vulnerabilities: DataFrame) -> DataFrame:
    """Distinct files in order."""
    return vulnerabilities.select("file").distinct().orderBy("file")


def write_vulnerability_csv(vulnerabilities: DataFrame, path: str) -> None:
    vulnerabilities.select("level", F.col("rule_id").alias("rule"), "file", "line").write.mode(
        "overwrite"
    ).csv(path, header=True)
