"""Centroid clustering with PCA-rotated filtering (operator 12).

Vectors of ``SIZE`` components become integers, floor(``SCALE`` * x), and are
clustered by ``ROUNDS`` exact rounds of nearest centroid and floored mean.

1. Means and second moments of all vectors are summed in Spark; their
   eigenvectors rotate the space (one ``SIZE`` x ``SIZE`` matrix).
2. Every vector is stored once with its integers, its first ``LEAD`` rotated
   coordinates and the norm of the rest (the residual).
3. In a round a task computes, for every centroid, the projected squared
   distance plus the squared difference of the residual norms.  That is at most
   the true distance (the triangle inequality for the rest), less a slack for
   rounding.  Centroids are verified in rising order of the bound, in integers;
   one whose bound exceeds the best distance so far is left out.
4. Only counts and componentwise sums per centroid leave a round, as partial
   sums; the driver holds the centroids and the rotation, whose size is fixed.

Each round reads the stored table anew, so a lost executor costs its tasks of
one round.  Results are exact integers and do not depend on the rotation, on
partitions or on task order.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out.  Repeated rows are vectors of their own.  A
null id sorts last among the starting vectors.  With fewer vectors than
centroids every vector starts one.  An empty table gives an empty result;
further columns are ignored.  A component of 2^27 or more after scaling
(|x| of 131,072 at the default scale) raises an error, since squared distances
of such vectors would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.storage import written

SIZE, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
LEAD = 16                # rotated coordinates that are stored
LARGEST = 1 << 27        # components below it keep 64 squared differences within a long
ROWS = 8_192             # vectors handled at once in a task
SLACK = 1e-5             # share of the norms by which a bound is lowered: far above the rounding of float32 coordinates


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of ``size`` ints) of every vector that is whole and finite."""
    x = F.col("embedding")
    whole = (F.size(x) == size) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    least = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    # a component that is too large stops the query instead of wrapping
    fits = F.when(F.exists(x, lambda c: F.abs(c.cast("double")) * scale >= LARGEST),
                  F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling: its distances do not fit a long")).cast("array<int>"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(whole, F.lit(False)))
            .select("vec_id", F.coalesce(fits, least.cast("array<int>")).alias("v")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column without nulls, as one int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def starts(vecs: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vecs.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def _added(stored: DataFrame, of, kind: str) -> dict[int, int | float]:
    """The (key, s) rows that ``of`` makes of every task, added up by key; few fixed keys reach the driver."""
    return {r["key"]: r["s"] for r in stored.mapInArrow(of, f"key int, s {kind}").groupBy("key").agg(F.sum("s").alias("s")).collect()}


def _cells(table: np.ndarray) -> pa.RecordBatch:
    """A table as (key, s) rows, keyed by the place in it, without its zeros."""
    flat = table.ravel()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["key", "s"])


def rotation(vecs: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and eigenvectors (columns, largest variance first) of all vectors; (``size`` + 1)^2 sums reach the driver."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size + 1, size + 1))
        for part in _parts(batches):
            x = np.column_stack([_matrix(part.column("v"), size), np.ones(part.num_rows)])
            table += x.T @ x
        yield _cells(table)

    table = np.zeros((size + 1) ** 2)
    for key, s in _added(vecs.select("v"), of, "double").items():
        table[key] = s
    table = table.reshape(size + 1, size + 1) / max(table[-1], 1)
    mean = table[size, :size]
    return mean, np.linalg.eigh(table[:size, :size] - np.outer(mean, mean))[1][:, ::-1]


def _rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``lead`` rotated coordinates and the norm of the others."""
    turned = (x - mean) @ axes
    return turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)


def rotated(vecs: DataFrame, mean: np.ndarray, axes: np.ndarray, size: int = SIZE, lead: int = LEAD) -> DataFrame:
    """vec_id, v and the filter's columns: lead (float32 coordinates) and rest (residual norm)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            y, rest = _rotate(_matrix(part.column("v"), size), mean, axes, lead)
            flat = pa.array(y.astype(np.float32).ravel())
            offsets = pa.array(np.arange(0, y.size + 1, lead, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.ListArray.from_arrays(offsets, flat), pa.array(rest)],
                                             names=["vec_id", "v", "lead", "rest"])

    return vecs.mapInArrow(of, "vec_id long, v array<int>, lead array<float>, rest double")


class Filter:
    """Centroids with their rotated form: exact nearest centroid through lower bounds."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int = LEAD) -> None:
        self.centroids = centroids
        self.y, self.rest = _rotate(centroids, mean, axes, lead)

    def nearest(self, v: np.ndarray, y: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of every row (ties: smaller number), and distances computed."""
        norm = np.sqrt((y * y).sum(1) + rest * rest)
        norms = np.sqrt((self.y * self.y).sum(1) + self.rest * self.rest)
        gap = np.stack([((y - c) ** 2).sum(1) + (rest - r) ** 2 for c, r in zip(self.y, self.rest)], axis=1)
        bound = np.maximum(np.sqrt(gap) - SLACK * (norm[:, None] + norms[None, :] + 1), 0) ** 2
        order = np.argsort(bound, axis=1)
        best, of, done = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64), 0
        for rank in range(len(self.centroids)):
            number = order[:, rank]
            # a bound that equals the best distance may still be a tie of a smaller number
            live = np.flatnonzero(bound[np.arange(len(v)), number] <= best * (1 + 1e-12) + 1)
            if not len(live):
                break
            done += len(live)
            k = number[live]
            apart = v[live] - self.centroids[k]
            d = np.einsum("ij,ij->i", apart, apart)
            win = (d < best[live]) | ((d == best[live]) & (k < of[live]))
            best[live[win]], of[live[win]] = d[win], k[win]
        return of, best, done


def _columns(part: pa.RecordBatch, size: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = part.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(-1, lead).astype(float)
    return _matrix(part.column("v"), size), y, part.column("rest").to_numpy(zero_copy_only=False)


def assigned(stored: DataFrame, to: Filter, size: int = SIZE, lead: int = LEAD) -> DataFrame:
    """vec_id, cluster, distance of every stored vector."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            k, d, _ = to.nearest(*_columns(part, size, lead))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(k, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(of, "vec_id long, cluster int, distance long")


def moved(stored: DataFrame, to: Filter, size: int = SIZE, lead: int = LEAD) -> np.ndarray:
    """The centroids after one round: floored means of their vectors; ``size`` + 1 sums per centroid reach the driver."""
    many = len(to.centroids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, size + 1), np.int64)
        for part in _parts(batches):
            v, y, rest = _columns(part, size, lead)
            k, _, _ = to.nearest(v, y, rest)
            for c in range(many):
                total[c, :size] += v[k == c].sum(0)
            total[:, size] += np.bincount(k, minlength=many)
        yield _cells(total)

    found = _added(stored, of, "long")
    out = to.centroids.copy()
    for c in range(many):
        n = found.get(c * (size + 1) + size)
        if n:
            out[c] = [found.get(c * (size + 1) + i, 0) // n for i in range(size)]
    return out


def cluster(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT,
            lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    vecs = integers(vectors, size, scale)
    centroids = starts(vecs, k, salt)
    if not len(centroids):
        return vecs.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    mean, axes = rotation(vecs, size)
    stored = written(rotated(vecs, mean, axes, size, lead), "centroid-vectors")
    for _ in range(rounds):
        centroids = moved(stored, Filter(centroids, mean, axes, lead), size, lead)
    return written(assigned(stored, Filter(centroids, mean, axes, lead), size, lead), "centroid-clusters"), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, inertia of the cluster and of all, and a hash of the cluster's centroid."""
    found, centroids = cluster(vectors)
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    pick = F.create_map(*(F.lit(x) for i in range(len(hashes)) for x in (i, hashes[i]))) if hashes else F.create_map(F.lit(0), F.lit(""))
    inertia = F.create_map(*(F.lit(x) for i, s in sums.items() for x in (i, int(s)))) if sums else F.create_map(F.lit(0), F.lit(0))
    return found.select("vec_id", "cluster", "distance", F.element_at(inertia, F.col("cluster")).cast("long").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(pick, F.col("cluster")).alias("centroid_sha256"))


def sql(size: int = SIZE, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> str:
    """DuckDB twin of ``digest`` over ``embeddings``: every vector against every centroid, round by round."""
    def near(i: int) -> str:
        return f"""a{i} as materialized (
        select r, vec_id, arg_min(k, (d, k)) k, min(d) d from (
            select r, vec_id, k, cast(list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {size + 1})]) as bigint) d from vecs, c{i}) group by r, vec_id)"""

    def move(i: int) -> str:
        return f"""c{i + 1} as materialized (
        select k, coalesce(m.c, c{i}.c) c from c{i} left join (
            select k, list((s - ((s % n) + n) % n) // n order by i) c from (
                select k, i, cast(sum(v[i]) as bigint) s, count(*) n from vecs join a{i} using (r), unnest(range(1, {size + 1})) t(i) group by k, i) group by k) m using (k))"""

    steps = ",\n    ".join(x for i in range(rounds) for x in (near(i), move(i)))
    return f"""
    with vecs as materialized (
        select row_number() over () r, vec_id, [cast(floor({scale} * cast(x as double)) as bigint) for x in embedding] v from embeddings
        where len(embedding) = {size} and len([x for x in embedding if x is not null and isfinite(x)]) = {size}),
    c0 as materialized (select row_number() over (order by h nulls last, v) - 1 k, v c from (
        select sha256('{salt}' || cast(vec_id as varchar)) h, v from vecs order by h nulls last, v limit {k})),
    {steps},
    {near(rounds)}
    select vec_id, cast(k as int) "cluster", d distance, cast(sum(d) over (partition by k) as bigint) cluster_inertia,
           cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c, ',')) centroid_sha256
    from a{rounds} join c{rounds} using (k)"""
