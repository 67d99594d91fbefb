"""Centroid clustering with ns-bounds: every round keeps what bounds prove and rescans the rest exactly.

All centroids of all rounds are kept (rounds x clusters vectors). A vector
carries the round of its last full evaluation and, for each centroid, the whole
part of its distance at that time: a lower bound. Later the bound is loosened by the norm of the
centroid's total displacement since that round, not by the sum of its drifts, so a centroid that
wanders back costs nothing. The distance to the vector's own centroid is always
computed; if it lies below all loosened bounds the vector stays, else all its
distances are computed again. Results equal those of plain rounds.

Vectors are integers, so sums, floors and squared distances are exact. A round
writes the vectors with their bounds, as small integers, into the shared folder
and reads them back; sums follow from the vectors that moved, per task before
the shuffle, and only clusters x components numbers reach the driver.

Vectors that are null, of another length, or hold a null or non-finite component
are left out. Components beyond 2^18 in size count as 2^18, so that distances fit a long.
Equal distances go to the smaller number. Repeated rows count separately; a null
id hashes as an empty one, and rows with equal hashes start in the order of their components.
Fewer vectors than clusters give as many clusters as vectors. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

CLUSTERS = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
LARGEST = 2.0**18  # components are held to this size
EXACT = 1 << 20  # integers up to this size have exact products and sums in doubles
SLACK = 1e-6  # above the rounding of square roots and norms


def kept_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows with ``dimension`` finite components, each turned into floor(scale * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = lambda e: F.floor(scale * F.greatest(F.least(e.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)))
    rows = vectors.where(F.coalesce((F.size(x) == dimension) & finite, F.lit(False)))
    return rows.select("vec_id", F.transform(x, lambda e: whole(e).cast("int")).alias("v"))


def start_hash(seed: int = 2) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def starting_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 2) -> np.ndarray:
    """The ``clusters`` vectors with the smallest hashes of their ids, a bounded number of rows."""
    rows = vectors.orderBy(start_hash(seed), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def whole_roots(squares: np.ndarray) -> np.ndarray:
    """Floors of square roots."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root


def reassigned(
    v: np.ndarray, cluster: np.ndarray, seen: np.ndarray, lower: np.ndarray, history: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, seen, lower, squared distance, rescanned) against the last centroids of ``history``.

    ``history`` is (rounds, clusters, components); ``seen`` is -1 for vectors never evaluated.
    """
    now = len(history) - 1
    rows = np.arange(len(v))
    known = seen >= 0
    moved = np.sqrt(((history - history[now]) ** 2).sum(2).astype(np.float64))
    own = np.zeros(len(v), np.int64)
    own[known] = ((v[known] - history[now][cluster[known]]) ** 2).sum(1)
    bound = lower - moved[np.maximum(seen, 0)]
    bound[rows, np.maximum(cluster, 0)] = np.inf
    rescan = ~known | (bound.min(1) <= np.sqrt(own.astype(np.float64)) + SLACK)
    cluster, seen, lower = cluster.copy(), seen.copy(), lower.copy()
    if rescan.any():
        all_of = squared(v[rescan], history[now])
        cluster[rescan] = all_of.argmin(1)
        own[rescan] = all_of.min(1)
        seen[rescan] = now
        lower[rescan] = whole_roots(all_of)
    return cluster, seen, lower, own, rescan


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.astype(np.int32).ravel())
    )


def assigned(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after a round: vec_id, v, cluster, was, seen, lower, distance. The first round starts from (vec_id, v)."""
    fresh = "cluster" not in state.columns
    whole, several = T.IntegerType(), T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [state.schema["vec_id"], T.StructField("v", several), T.StructField("cluster", whole), T.StructField("was", whole),
         T.StructField("seen", whole), T.StructField("lower", several), T.StructField("distance", T.LongType())]
    )
    clusters, dimension = history.shape[1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            v = matrix(batch.column("v"), dimension)
            if fresh:
                was, seen, lower = np.full(n, -1), np.full(n, -1), np.zeros((n, clusters), np.int64)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int64)
                seen = batch.column("seen").to_numpy().astype(np.int64)
                lower = matrix(batch.column("lower"), clusters)
            cluster, seen, lower, own, _ = reassigned(v, was, seen, lower, history)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)),
                 pa.array(was.astype(np.int32)), pa.array(seen.astype(np.int32)), lists(lower), pa.array(own)],
                schema.names,
            )

    columns = ["vec_id", "v"] if fresh else ["vec_id", "v", "cluster", "seen", "lower"]
    return state.select(*columns).mapInArrow(work, schema)


def moved_sums(state: DataFrame, clusters: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """How the vectors that changed cluster change counts and sums: (clusters), (clusters, components)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(clusters, np.int64), np.zeros((clusters, dimension), np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), dimension)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy()
                has = at >= 0
                np.add.at(count, at[has], sign)
                np.add.at(total, at[has], sign * v[has])
        table_ = np.column_stack([count, total])
        cluster, part = np.nonzero(table_)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(table_[cluster, part])],
            ["cluster", "part", "change"],
        )

    moved = state.where("cluster <> was").select("v", "cluster", "was")
    parts = moved.mapInArrow(work, "cluster int, part int, change long").groupBy("cluster", "part").agg(F.sum("change").alias("change"))
    changes = np.zeros((clusters, dimension + 1), np.int64)
    for row in parts.collect():  # at most clusters x (components + 1) rows
        changes[row["cluster"], row["part"]] = row["change"]
    return changes[:, 0], changes[:, 1:]


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION,
    scale: int = SCALE, seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """The last state of every kept vector, and the final centroids."""
    state = kept_vectors(vectors, dimension, scale)
    start = starting_centroids(state, clusters, seed)
    if len(start) == 0:
        empty = state.select(
            "vec_id", "v", *[F.lit(None).cast("int").alias(c) for c in ("cluster", "was", "seen")],
            F.lit(None).cast("array<int>").alias("lower"), F.lit(None).cast("long").alias("distance"),
        )
        return empty.where(F.lit(False)), np.zeros((0, dimension), np.int64)
    history = start[None]
    count, total = np.zeros(len(start), np.int64), np.zeros(start.shape, np.int64)
    for step in range(rounds):
        state = saved(assigned(state, history), f"centroids-round{step}")
        more, sums = moved_sums(state, len(start), dimension)
        count, total = count + more, total + sums
        following = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], history[-1])
        history = np.concatenate([history, following[None]])
    return saved(assigned(state, history), "centroids-last"), history[-1]


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for all kept vectors."""
    state, centroids = clustered(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame(
        [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )  # one row per cluster
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def rounds_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> str:
    """Plain rounds in DuckDB: every vector against every centroid."""
    parts = [rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * greatest(least(CAST(x AS DOUBLE), {LARGEST}), -{LARGEST})) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimension}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v
  FROM kept ORDER BY k LIMIT {clusters}
)"""]
    nearest = """, a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT kept.r, c.k, CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept CROSS JOIN c{i} c
  ) GROUP BY r
)"""
    means = """, m{j} AS MATERIALIZED (
  SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT k, i, sum(x) AS s, count(*) AS n FROM (
      SELECT a.k, unnest(kept.v) AS x, generate_subscripts(kept.v, 1) AS i FROM kept JOIN a{i} a ON kept.r = a.r
    ) GROUP BY k, i
  ) GROUP BY k
), c{j} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{j}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{j} ON c{i}.k = m{j}.k)"""
    for i in range(rounds):
        parts += [nearest.format(i=i), means.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return "".join(parts) + f"""
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a ON kept.r = a.r JOIN c{rounds} c ON a.k = c.k
"""


SQL = rounds_sql()
