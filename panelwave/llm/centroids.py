"""Exact k-means rounds over integer vectors with geometrically tightened bounds.

A vector keeps an upper bound of its distance to its centroid and one lower bound of that to all others. When centroids
move, the lower bound of a cluster's vectors is not loosened by the whole drift: all of them lie in the sphere around
their old centroid, and a move of another centroid from c to c' brings it nearer to points of that sphere by at most
|c' - c| cos(angle), where the angle is that between the move and the sphere as seen from the middle of the move, in the
plane of the three centres. Vectors whose bounds do not part are scanned exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.operators.sizing import materialize, ship_package

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: components are held to this, so that squared distances of 64 components fit in a long
MOST = 1 << 27
#: bounds are doubles: they decide only where they part by more than their rounding
SLACK = 1e-9


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>) of the vectors with exactly dims components, none of them null or not finite."""
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("__x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = table.select(F.col(vec_id).alias("vec_id"), double.alias("__x")).filter((F.size("__x") == dims) & ~bad)
    held = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    # held before the cast to long that floor makes, which would fail on the largest doubles
    within = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST)))
    return kept.select("vec_id", F.transform("__x", lambda x: held(within(x))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; of a repeated id the smaller vector first."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("mark", mark).orderBy("mark", "v").limit(clusters).select("v").collect()  # clusters rows
    return np.array([r.v for r in rows], np.int64)


def gained(old: np.ndarray, new: np.ndarray, middle: np.ndarray, radius: float) -> float:
    """How much nearer than before a centroid that moved from old to new can be to a point of the sphere, at most.

    Points that gain more than |move| cos(t) lie within a cone of half angle t around the move, whose tip is the
    middle of the move (the hyperboloid with foci old and new lies inside its asymptotes).
    """
    move = new - old
    length = float(np.sqrt(move @ move))
    if length == 0:
        return 0.0
    to = middle - (old + new) / 2
    far2 = float(to @ to)
    if far2 <= radius * radius * (1 + SLACK) + SLACK:
        return length  # the tip is inside the sphere
    along = float(to @ move) / length
    aside = np.sqrt(max(far2 - along * along, 0.0))
    edge = np.sqrt(far2 - radius * radius)
    # the sphere is seen under asin(radius / far): it holds the axis where that is more than its angle to the axis
    if along > 0 and aside * edge <= along * radius:
        return length
    cosine = (along * edge + aside * radius) / far2
    return min(length, max(0.0, length * cosine * (1 + SLACK) + SLACK))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, what its vectors' lower bounds lose: the most that any other centroid gains on its sphere."""
    k = len(old)
    a, b = old.astype(float), new.astype(float)
    return np.array([max((gained(a[j], b[j], a[i], radius[i]) for j in range(k) if j != i), default=0.0) for i in range(k)])


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, centroids: np.ndarray, near: np.ndarray, cluster: np.ndarray, upper: np.ndarray,
           lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after one assignment; near is half the distance to the next centroid."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    least = np.maximum(lower, near[cluster])
    apart = lambda rows: upper[rows] * (1 + SLACK) + SLACK < least[rows]
    every = np.arange(len(v))
    open_ = every[~apart(every)]
    if len(open_):  # first with the exact distance to the own centroid
        upper[open_] = np.sqrt(squared(v[open_], centroids[cluster[open_]]).astype(float))
        open_ = open_[~apart(open_)]
    scanned = np.zeros(len(v), bool)
    if len(open_):
        scanned[open_] = True
        found = np.stack([squared(v[open_], c) for c in centroids], axis=1)
        best = found.argmin(axis=1)  # the first of equal ones
        row = np.arange(len(open_))
        cluster[open_], upper[open_] = best, np.sqrt(found[row, best].astype(float))
        found[row, best] = np.iinfo(np.int64).max
        second = found.min(axis=1)
        lower[open_] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(float)))
    return cluster, upper, lower, scanned


def _fields(vectors: DataFrame) -> list[T.StructField]:
    """Columns that are kept from one assignment to the next."""
    return [
        vectors.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()),
        T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("scans", T.IntegerType()),
    ]


def _step(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, loss: np.ndarray | None, last: bool) -> DataFrame:
    """The state after one assignment; the last one adds exact squared distances. Without drift all vectors are scanned."""
    k, dims = centroids.shape
    schema = T.StructType(_fields(state) + [T.StructField("distance", T.LongType())] * last)
    names = schema.fieldNames()
    gaps = np.sqrt(np.array([squared(centroids, c) for c in centroids]).astype(float))
    np.fill_diagonal(gaps, np.inf)
    near = gaps.min(axis=1) / 2
    ship_package(state.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            v = np.array(col["v"].flatten()).reshape(n, dims).astype(np.int64)
            if drift is None:
                cluster, upper, lower, scans = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int32)
            else:
                cluster, upper, lower, scans = (col[c].to_numpy() for c in ("cluster", "upper", "lower", "scans"))
                upper, lower = upper + drift[cluster], np.maximum(lower - loss[cluster] - SLACK, 0.0)
            cluster, upper, lower, scanned = assign(v, centroids, near, cluster, upper, lower)
            arrays = [col["vec_id"], col["v"], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower),
                      pa.array((scans + scanned).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(squared(v, centroids[cluster]))] * last, names)

    return state.mapInArrow(run, schema)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids (exact floors of means; empty ones stay) and the radius of each old cluster's sphere."""
    k, dims = centroids.shape
    sums: list[Column] = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("r"), *sums).collect()  # at most k rows
    new, radius = centroids.copy(), np.zeros(k)
    for row in rows:
        new[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
        radius[row.cluster] = row.r
    return new, radius


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS,
                    rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, upper, lower, scans, distance) of each kept vector, final centroids).

    Vectors count as integers floor(scale * x). Every round assigns all vectors to the nearest centroid (ties: smaller
    number) and moves centroids to the floors of their means; then vectors are assigned once more. scans tells in how
    many of these assignments a vector was scanned exactly; the others were decided by bounds.

    Vectors that are null, of another length, or have null or non-finite components are left out. A null id is kept
    (hashed as an empty text); repeated rows are vectors of their own. Components are held to +-2^27, beyond which a
    squared distance does not fit in a long. Fewer vectors than clusters: as many centroids as vectors; none: no rows.
    The table is written once a round; only centroids (clusters x dims numbers) pass through the driver.
    """
    vectors = materialize(integer_vectors(table, vec_id, vector, dims, scale))
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        schema = T.StructType([*_fields(vectors), T.StructField("distance", T.LongType())])
        return table.sparkSession.createDataFrame([], schema), centroids
    state = materialize(_step(vectors, centroids, None, None, rounds == 0))
    for left in range(rounds, 0, -1):
        new, radius = _moved(state, centroids)
        drift = np.sqrt(np.array([float(d @ d) for d in (new - centroids).astype(float)])) * (1 + SLACK)
        state = materialize(_step(state, new, drift, loosening(centroids, new, radius), left == 1))
        centroids = new
    return state, centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # one row for each of at most 16 clusters
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    long_ = lambda x: int(x) if x < 1 << 63 else None
    total = long_(sum(r.total for r in sums))
    per = spark.createDataFrame([(r.cluster, long_(r.total), total, digest(centroids[r.cluster])) for r in sums],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Three rounds of assignment and exact floors of means, then the last assignment."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT k - 1 AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256("
        f"'{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS k FROM kept) WHERE k <= {CLUSTERS})",
    ]
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS (SELECT vec_id, v, min(struct_pack(d := CAST({far} AS BIGINT), k := k)) AS b "
                     f"FROM (SELECT row_number() OVER () AS i, vec_id, v FROM kept), c{r} GROUP BY i, vec_id, v)")
        if r < ROUNDS:
            parts.append(
                f"m{r} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT b.k AS k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) "
                f"// count(*) AS BIGINT) AS m FROM (SELECT b, unnest(v) AS x, unnest(range(1, {DIMS} + 1)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY k)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{ROUNDS} ON c{ROUNDS}.k = b.k
"""


OP12_SQL = _sql()
