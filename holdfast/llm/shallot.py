"""Exact centroid clustering of integer vectors by Shallot search.

Every vector carries a bound above its distance to its centroid, a bound below its distance to all others, and the number
of its second-nearest centroid. The bounds follow the centroids' moves; a vector whose bounds do not meet keeps its
centroid unseen. Any other is measured against its centroid and the remembered second one, and the closer of the two
becomes the middle of a search: its neighbours are visited from near to far, while they lie in a ball of the distance
to the middle plus the distance to the second best so far. The ball shrinks with every better one. Bounds are floating
point, rounded outwards; vectors that survive them are compared by whole squared distances in integers, ties by the
smaller number.

The vectors are written once, as batches bucketed by batch. A round joins the state of the last one (about ten bytes a
vector) to them, and writes the new state and the sums of each task; only the sums of k clusters reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import expand, squeeze
from holdfast.llm.components import stored
from holdfast.session import work_path

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
BATCH = 4096

# Integers up to here have squared distances that fit 64 bits, at any width up to 128.
_SAFE = 1 << 27
_LIMB = 31
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12

_STEP_SCHEMA = "kind int, gid long, blob binary, cluster int, dim int, limb int, value long"


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles (scale a power of two), in the narrowest integers that hold all of them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    most = np.abs(scaled).max(initial=0)
    for kind in (np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return scaled.astype(kind)
    # Beyond 2**53 a double is whole already, so the product is taken in integers.
    big = [math.floor(s) if math.isfinite(s) else int(x) * scale for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array(big, dtype=object).reshape(values.shape)


def _squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the centroid beside it."""
    away = vectors.astype(centroids.dtype) - centroids
    return np.einsum("ij,ij->i", away, away) if away.dtype != object else (away * away).sum(axis=1)


def _fits(vectors: np.ndarray) -> bool:
    return vectors.dtype != object and (not vectors.size or int(np.abs(vectors.astype(np.int64)).max()) <= _SAFE)


class Centroids:
    """The centroids of a round, how far each moved to get there, and each one's neighbours from near to far."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        self.small = all(abs(v) <= _SAFE for row in [*rows, *(before or [])] for v in row)
        self.exact = np.array(rows, dtype=np.int64 if self.small else object).reshape(len(rows), -1)
        self.k = len(rows)
        if not self.small:
            return
        away = np.array([_squared(self.exact, np.broadcast_to(c, self.exact.shape)) for c in self.exact], dtype=np.float64)
        gaps = np.sqrt(away) * _DOWN
        np.fill_diagonal(gaps, -1)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.half = self.gaps[:, 0] / 2 if self.k > 1 else np.full(1, np.inf)
        moved = _squared(self.exact, np.array(before, dtype=np.int64)) if before else np.zeros(self.k)
        self.moved = np.sqrt(moved.astype(np.float64)) * _UP
        top = np.argsort(self.moved)
        self.others_moved = np.where(np.arange(self.k) == top[-1], self.moved[top[-2]] if self.k > 1 else 0, self.moved[top[-1]])


def _scan_all(vectors: np.ndarray, centroids: Centroids):
    """Nearest, second-nearest and their squared distances, each vector against every centroid."""
    kind = np.int64 if centroids.small and _fits(vectors) else object
    exact = centroids.exact.astype(kind)
    away = np.stack([_squared(vectors.astype(kind), np.broadcast_to(c, vectors.shape)) for c in exact], axis=1)
    order = np.argsort(away, axis=1, kind="stable")
    best = order[:, 0]
    second = order[:, 1] if centroids.k > 1 else best
    rows = np.arange(len(vectors))
    return best, second, away[rows, best], away[rows, second]


def search(vectors: np.ndarray, centroids: Centroids, state):
    """The new state (nearest, second, bound above, bound below) of the vectors."""
    if state is None or not centroids.small or not _fits(vectors):
        best, second, near, next_ = _scan_all(vectors, centroids)
        if near.dtype == object:
            # Without bounds: such vectors are always measured.
            return best, second, np.full(len(best), np.inf), np.zeros(len(best))
        lower = np.sqrt(next_.astype(np.float64)) * _DOWN if centroids.k > 1 else np.full(len(best), np.inf)
        return best, second, np.sqrt(near.astype(np.float64)) * _UP, lower
    best, second, upper, lower = (x.copy() for x in state)
    upper = (upper + centroids.moved[best]) * _UP
    lower = lower - centroids.others_moved[best]
    lower -= np.abs(lower) * 1e-12
    open_ = np.flatnonzero(~(upper < np.maximum(lower, centroids.half[best])))
    near = _squared(vectors[open_], centroids.exact[best[open_]])
    upper[open_] = np.sqrt(near.astype(np.float64)) * _UP
    still = ~(upper[open_] < np.maximum(lower[open_], centroids.half[best[open_]]))
    open_, near = open_[still], near[still]
    if centroids.k < 2 or not len(open_):
        return best, second, upper, lower

    v, a, s = vectors[open_], best[open_], second[open_]
    next_ = _squared(v, centroids.exact[s])
    swap = (next_ < near) | ((next_ == near) & (s < a))
    a, s = np.where(swap, s, a), np.where(swap, a, s)
    near, next_ = np.where(swap, next_, near), np.where(swap, near, next_)
    middle, second_of_middle, reach = a.copy(), s.copy(), np.sqrt(near.astype(np.float64)) * _UP
    inside = np.arange(len(open_))
    for rank in range(centroids.k - 1):
        ball = (reach[inside] + np.sqrt(next_[inside].astype(np.float64)) * _UP) * _UP
        inside = inside[~(centroids.gaps[middle[inside], rank] > ball)]
        if not len(inside):
            break
        j = centroids.order[middle[inside], rank]
        # The remembered one has been measured.
        fresh = j != second_of_middle[inside]
        at, j = inside[fresh], j[fresh]
        far = _squared(v[at], centroids.exact[j])
        first = (far < near[at]) | ((far == near[at]) & (j < a[at]))
        other = ~first & ((far < next_[at]) | ((far == next_[at]) & (j < s[at])))
        s[at] = np.where(first, a[at], np.where(other, j, s[at]))
        next_[at] = np.where(first, near[at], np.where(other, far, next_[at]))
        a[at], near[at] = np.where(first, j, a[at]), np.where(first, far, near[at])
    best[open_], second[open_] = a, s
    upper[open_] = np.sqrt(near.astype(np.float64)) * _UP
    lower[open_] = np.sqrt(next_.astype(np.float64)) * _DOWN
    return best, second, upper, lower


def _packed_state(state) -> bytes:
    best, second, upper, lower = state
    with np.errstate(over="ignore"):
        above = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
        below = np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
    return squeeze((best.astype(np.uint16), second.astype(np.uint16), above, below))


def _state_of(blob: bytes | None):
    if blob is None:
        return None
    best, second, upper, lower = expand(blob)
    return best.astype(np.int64), second.astype(np.int64), upper.astype(np.float64), lower.astype(np.float64)


def _kept(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `width` finite components, and these components as doubles."""
    lists = part.column("vector")
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    fine = np.isfinite(values).all(axis=1)
    return at[fine], values[fine]


def _pack(vectors: DataFrame, width: int, scale: int) -> tuple[DataFrame, str]:
    """The kept vectors in batches (gid, blob of ids, null ids and whole numbers), bucketed by gid; and the table's name."""
    spark = vectors.sparkSession

    def run(batches):
        task, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                at, values = _kept(part, width)
                if not len(at):
                    continue
                ids = part.column("vec_id").take(pa.array(at))
                null = np.asarray(ids.is_null())
                content = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, whole_numbers(values, scale)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | i]), pa.array([squeeze(content)], pa.binary())], ["gid", "blob"])
                i += 1

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = vectors.mapInArrow(run, "gid long, blob binary").repartition(buckets, "gid")
    name = f"vectors_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "gid").option("path", work_path(spark, name)).saveAsTable(name)
    return spark.table(name), name


def _starts(packed: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least sha256 of `seed:vec_id`; vectors without an id start nothing."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                ids, null, vectors = expand(blob)
                names = sorted((hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), i) for i in np.flatnonzero(~null).tolist())
                # Rows that repeat an id have one hash; the order of their components, as text, decides.
                last = names[k - 1][0] if len(names) >= k else "g"
                seen = sorted((h, ",".join(map(str, vectors[i].tolist()))) for h, i in names if h <= last)[:k]
                columns = [pa.array([x[c] for x in seen], pa.string()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "vector"])

    rows = packed.select("blob").mapInArrow(run, "hash string, vector string").orderBy("hash", "vector").limit(k).collect()
    return [[int(x) for x in r.vector.split(",")] for r in rows]


def _limbs(numbers: np.ndarray):
    """(place, limb, value) of the integers in base 2**31; the last limb has the sign."""
    limb, places = 0, np.arange(len(numbers))
    while len(places):
        done = np.array([-(1 << _LIMB) <= v < (1 << _LIMB) for v in numbers], bool)
        for p, v in zip(places[done].tolist(), numbers[done].tolist(), strict=True):
            yield p, limb, v
        places, numbers = places[~done], numbers[~done]
        for p, v in zip(places.tolist(), numbers.tolist(), strict=True):
            yield p, limb, v & ((1 << _LIMB) - 1)
        numbers, limb = numbers >> _LIMB, limb + 1


def _round(rows: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """Assign all vectors; new states (kind 0) and the sums and counts of the clusters (kind 1)."""
    k = centroids.k
    arrow = pa.schema([(n, t) for n, t in zip("kind gid blob cluster dim limb value".split(), (pa.int32(), pa.int64(), pa.binary(), *[pa.int32()] * 3, pa.int64()))])

    def run(batches):
        total = np.zeros((k, width + 1), dtype=object)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = expand(row["blob"])[2]
                state = search(vectors, centroids, _state_of(row["state"]))
                for c in np.unique(state[0]).tolist():
                    mine = vectors[state[0] == c]
                    total[c, :width] += mine.sum(axis=0, dtype=None if mine.dtype == object else np.int64).astype(object)
                    total[c, width] += len(mine)
                yield pa.RecordBatch.from_pylist([{"kind": 0, "gid": row["gid"], "blob": _packed_state(state)}], schema=arrow)
        sums = [
            {"kind": 1, "cluster": p // (width + 1), "dim": p % (width + 1), "limb": limb, "value": int(v)}
            for p, limb, v in _limbs(total.ravel())
            if v
        ]
        yield pa.RecordBatch.from_pylist(sums, schema=arrow)

    return stored(rows.mapInArrow(run, _STEP_SCHEMA), "round")


def _means(made: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """floor(sum / count) of every cluster; an empty one stays where it is."""
    total = [[0] * (width + 1) for _ in centroids]
    # Clusters times components times limbs.
    for r in made.where("kind = 1").groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        total[r.cluster][r.dim] += r.value << (_LIMB * r.limb)
    return [[s // t[width] for s in t[:width]] if t[width] else old for t, old in zip(total, centroids, strict=True)]


def _final(rows: DataFrame, centroids: Centroids) -> DataFrame:
    arrow = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, null, vectors = expand(row["blob"])
                cluster = search(vectors, centroids, _state_of(row["state"]))[0]
                kind = np.int64 if centroids.small and _fits(vectors) else object
                away = _squared(vectors.astype(kind), centroids.exact.astype(kind)[cluster]).tolist()
                distance = pa.array([d if d < 1 << 63 else None for d in away], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(cluster.astype(np.int32)), distance], schema=arrow)

    return stored(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")


def cluster_vectors(
    vectors: DataFrame,
    column: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with null, infinite or missing components, or another width, are left out. A null vec_id is kept and
    assigned, but is no start. Rows that repeat a vec_id are separate vectors. With fewer than k vectors with an id
    there are fewer centroids; with none the result is empty. A distance or sum beyond 64 bits is null, while the assignment stays exact.
    Extra columns are ignored.
    """
    spark = vectors.sparkSession
    thin = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    packed, name = _pack(thin, width, scale)
    centroids, before, rows = _starts(packed, k, seed), None, packed.withColumn("state", F.lit(None).cast("binary"))
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        made = _round(rows, Centroids(centroids, before), width)
        before, centroids = centroids, _means(made, centroids, width)
        states = made.where("kind = 0").select("gid", F.col("blob").alias("state"))
        rows = packed.join(states, "gid")
    found = _final(rows, Centroids(centroids, before))
    spark.sql(f"DROP TABLE {name}")

    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), whole).alias("sum")).collect()
    inertia = {r.cluster: None if r["sum"] is None or r["sum"] >= 1 << 63 else int(r["sum"]) for r in sums}
    every = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = [(c, inertia[c], every, names[c]) for c in inertia]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
