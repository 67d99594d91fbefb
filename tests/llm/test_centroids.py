"""Clustering beside plain rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from leakscan_spark.llm import centroids


def plain(rows, clusters, rounds, dimension):
    kept = [
        (i, [math.floor(256 * max(min(x, 2.0**18), -(2.0**18))) for x in v])
        for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=name)[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [
            [sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)
        ]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), centres


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)


def run(vectors, rows, clusters, rounds, dimension):
    state, centres = centroids.clustered(vectors([(*r, 7) for r in rows]), clusters, rounds, dimension)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()), key=str)
    assert (got, centres.tolist()) == plain(rows, clusters, rounds, dimension)
    return state


def test_equal_to_plain_rounds(vectors):
    pick = random.Random(5)
    rows = [(i, [pick.gauss(pick.choice([-1, 0, 1]), 0.3) for _ in range(6)]) for i in range(400)]
    state = run(vectors, rows, 8, 6, 6)
    # Bounds spared some vectors the last rescan.
    assert state.where("seen < 6").count() > 0


def test_odd_vectors_ties_and_copies(vectors):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [-inf, 1.0]), (8, [1.0, 2.0, 3.0]),
        (None, [0.5, 0.5]), (9, [0.0, 0.0]), (9, [0.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0]), (11, [-0.001, 0.003]),
        (12, [1e300, -1e300]), (13, [2.0, 0.0]), (14, [4.0, 0.0]),
    ]
    run(vectors, rows, 3, 4, 2)
    run(vectors, rows, 40, 2, 2)  # fewer vectors than clusters


def test_no_vectors(vectors):
    state, centres = centroids.clustered(vectors([(1, [1.0], 0)]), 3, 2, 2)
    assert state.count() == 0 and centres.shape == (0, 2)


def test_empty_clusters_stay(vectors):
    # Two equal starting centroids: the second never gets a vector.
    run(vectors, [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [9.0, 9.0]), (4, [9.5, 9.0])], 4, 3, 2)


def test_displacement_not_drift_loosens_bounds():
    # A centroid that returns leaves the bound as it was, so nothing is rescanned.
    v = np.array([[0, 0]])
    history = np.array([[[1, 0], [100, 0]], [[1, 0], [30, 0]], [[1, 0], [100, 0]]])
    first = centroids.reassigned(v, np.array([-1]), np.array([-1]), np.zeros((1, 2), np.int64), history[:1])
    last = centroids.reassigned(v, first[0], first[1], first[2], history)
    assert not last[4].any() and last[1].tolist() == [0]
    assert centroids.whole_roots(np.array([0, 1, 3, 4, 2**60 - 1, 2**60])).tolist() == [0, 1, 1, 2, 2**30 - 1, 2**30]


def test_far_components_have_exact_distances():
    far = 1 << 26
    v, c = np.array([[far, -far], [far, far - 1]]), np.array([[-far, far], [far, far]])
    assert centroids.squared(v, c).tolist() == [[2 * (2 * far) ** 2, (2 * far) ** 2], [(2 * far) ** 2 + 1, 1]]
