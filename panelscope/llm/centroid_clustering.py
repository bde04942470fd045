"""Centroid clustering with bounds that drift geometrically.

Vectors become integers and are assigned to the nearest of ``k`` integer
centroids, round by round. Each vector carries an upper bound of the distance
to its own centroid and a lower bound of the distance to any other. When
centroids move, the upper bound grows by its centroid's drift. The lower bound
would shrink by the largest drift of all; here it shrinks by less: all vectors
of a cluster lie in a sphere around its centroid, and how much nearer a moved
centroid can come to any point of that sphere is found in the plane through
the sphere's centre and the centroid's old and new place (it can even be
negative). Only vectors whose bounds then overlap are looked at, first against
their own centroid, then, if still ambiguous, against all centroids, exactly.

A round is one pass without a shuffle of vectors over the state (vector,
cluster, bounds), written to the shared checkpoint folder, and one aggregate
of k rows. Centroids, k rows of sums and k radii are all that reaches the driver.

Defined results: rows with another number of components than ``dims``, or with
a null or non-finite one, are left out; a null id counts as an empty text where
the first centroids are chosen; equal ids there go by their components;
repeated rows are vectors of their own; with fewer vectors than ``k`` there are
as many centroids as vectors; an empty table gives no rows; other columns are
ignored. Components from 2**31 on (after the scaling) make the query fail, as
their distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.layout import cut

DIMS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
ANGLES = 2048
#: Doubles hold sums of 64 products of differences below this exactly.
_EXACT = 1 << 22
#: Bounds are kept apart by more than what rounding can do to them.
_MARGIN = 1e-6

_STATE = "vec_id {}, vec array<int>, cluster int, upper double, lower double, distance long, scanned int"


def usable_vectors(embeddings: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, vec (integers) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embeddings.filter((F.size(x) == dims) & finite).select(
        "vec_id", F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("int")).alias("vec"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes."""
    h = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.select(h.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    return np.array([r["vec"] for r in got], dtype=np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``, as long."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and x.shape[1] <= DIMS:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.array([((row[None, :] - b) ** 2).sum(1) for row in a]).astype(np.int64).reshape(len(a), len(b))


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to the same row of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and x.shape[1] <= DIMS:
        return ((x - c) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1).astype(np.int64)


@dataclass
class Move:
    """New centroids, how far each moved, and by how much the lower bounds of
    each cluster's vectors shrink (below 0: grow)."""
    centroids: np.ndarray
    drift: np.ndarray
    loosen: np.ndarray


def nearer_by(centre: np.ndarray, radius: np.ndarray, old: np.ndarray, new: np.ndarray,
              angles: int = ANGLES) -> np.ndarray:
    """For each sphere (rows) and each move old -> new (columns): a bound of
    |x - old| - |x - new| over the points x of the sphere.

    The difference depends on a point's place along the line of the move and
    on its distance from that line only, so the sphere counts as the disc of
    that radius in the plane through its centre and the line. Its largest
    value lies on the circle: it has no maximum but on the ray beyond ``new``,
    which leaves the disc. It changes at most twice as fast as the point
    moves, which covers what lies between the angles looked at."""
    move = new - old
    p = np.sqrt((move * move).sum(1))
    unit = move / np.maximum(p, 1e-300)[:, None]
    away = centre[:, None, :] - (0.5 * (old + new))[None, :, :]
    along = (away * unit[None, :, :]).sum(2)
    beside = np.sqrt(np.maximum((away * away).sum(2) - along * along, 0.0))
    angle = np.arange(angles) * (2 * np.pi / angles)
    cos, sin = np.cos(angle), np.sin(angle)
    out = np.empty(along.shape)
    for i, r in enumerate(radius):
        x = along[i][:, None] + r * cos[None, :]
        y = beside[i][:, None] + r * sin[None, :]
        half = (p / 2)[:, None]
        out[i] = (np.hypot(x + half, y) - np.hypot(x - half, y)).max(1) + 2 * r * np.pi / angles
    return np.where(p[None, :] > 0, np.minimum(out, p[None, :]) + _MARGIN, 0.0)


def move_of(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    """``radius``: of the sphere around each old centroid that holds its vectors."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    nearer = nearer_by(a, radius, a, b)
    np.fill_diagonal(nearer, -np.inf)
    loosen = nearer.max(1) if len(a) > 1 else np.zeros(1)
    return Move(new, np.sqrt(((b - a) ** 2).sum(1)) + _MARGIN, loosen)


def scanned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals), squared distance to it, and
    distance to the nearest other one."""
    d = squared_distances(x, centroids)
    at = np.arange(len(x))
    own = d.argmin(1)
    best = d[at, own]
    if d.shape[1] == 1:
        return own, best, np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(d.min(1).astype(np.float64))


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move):
    """cluster, upper, lower after a move, and which rows were scanned in full."""
    cluster, upper = cluster.copy(), upper + move.drift[cluster]
    lower = lower - move.loosen[cluster]
    open_ = np.flatnonzero(upper + _MARGIN >= lower)
    upper[open_] = np.sqrt(own_distances(x[open_], move.centroids[cluster[open_]]).astype(np.float64))
    open_ = open_[upper[open_] + _MARGIN >= lower[open_]]
    full = np.zeros(len(x), np.int32)
    full[open_] = 1
    if len(open_):
        cluster[open_], best, lower[open_] = scanned(x[open_], move.centroids)
        upper[open_] = np.sqrt(best.astype(np.float64))
    return cluster, upper, lower, full


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(state: DataFrame, first: np.ndarray, move: Move | None, exact: bool) -> DataFrame:
    """The state after one assignment: to ``first`` centroids, or after a ``move``."""
    dims = first.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("vec"), dims)
            if move is None:
                cluster, best, lower = scanned(x, first)
                upper, full = np.sqrt(best.astype(np.float64)), np.ones(len(x), np.int32)
            else:
                cluster, upper, lower, full = reassigned(
                    x, *(batch.column(c).to_numpy() for c in ("cluster", "upper", "lower")), move)
            centroids = first if move is None else move.centroids
            distance = own_distances(x, centroids[cluster]) if exact else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(cluster.astype(np.int32)), pa.array(upper),
                 pa.array(lower), pa.array(distance), pa.array(full)],
                names=["vec_id", "vec", "cluster", "upper", "lower", "distance", "scanned"])

    return state.mapInArrow(run, _STATE.format(state.schema["vec_id"].dataType.simpleString()))


def cluster_states(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS,
                   dims: int = DIMS) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The state after each assignment, with the centroids that it was made to;
    nothing for a table without vectors."""
    state = usable_vectors(embeddings, dims)
    centroids = first_centroids(state, k)
    if not len(centroids):
        return
    move = None
    for turn in range(rounds + 1):
        state = cut(_assigned(state, centroids, move, turn == rounds))
        yield state, centroids
        if turn == rounds:
            return
        # at most k rows
        sums = state.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.max("upper").alias("radius"),
            F.array(*[F.sum(F.col("vec")[i]) for i in range(dims)]).alias("total")).collect()
        new, radius = centroids.copy(), np.zeros(len(centroids))
        for r in sums:
            new[r["cluster"]] = [v // r["n"] for v in r["total"]]
            radius[r["cluster"]] = r["radius"]
        move = move_of(centroids, new, radius + _MARGIN)
        centroids = new


def clustered(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 of every vector that takes part."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    state = None
    for state, centroids in cluster_states(embeddings, k, rounds, dims):
        pass
    if state is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    spread = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(spread.values())
    rows = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in sorted(spread.items())]
    # k rows at most
    summary = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
