"""Centroid clustering in exact integers: Lloyd's rounds whose distances come from one matrix product.

The squared distance is |x|^2 - 2 x.c + |c|^2, the product taken by BLAS in float64 over blocks of vectors. All of it is whole numbers, so as long as every sum of their
magnitudes stays below 2^53 the result is exact in whatever order BLAS adds; vectors (or centroids) too large for that are taken by integers instead. A task sums its
vectors up by cluster, and an RDD's treeAggregate combines these sums, so the driver gets one small table a round and results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, new_path, removed

#: Components of a vector, their scale, clusters, rounds, and the word that the draw of seeds hashes before an id.
DIM, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Vectors of a block.
BLOCK = 4096
EXACT, LONG = 2**53, 2**63


def _integers(x: np.ndarray) -> np.ndarray:
    """Floats that are whole numbers, or integers, as Python's integers."""
    return np.frompyfunc(int, 1, 1)(x)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as floats, which hold it exactly, if it is small enough for any use of floats, else as Python integers."""
    if np.abs(x).max(initial=0.0) < EXACT:
        return np.floor(SCALE * x)  # a product with a power of two is exact
    # From 2^53 on a double is a whole number itself.
    return np.array([[int(v) * SCALE if abs(v) >= EXACT else int(np.floor(SCALE * v)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number vectors x (floats or Python integers) from centroids c (Python integers): float64, int64 or object, exact in each."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    bound = x.shape[1] * most * most  # |x|^2 + 2 |x.c| + |c|^2 at most, term by term
    kind = np.float64 if bound < EXACT else np.int64 if bound < LONG else object
    x, c = (_integers(x) if kind is object else x.astype(kind)), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def _blocks(batch: pa.RecordBatch):
    """(first row, whole-number vectors) of a batch's column v; large vectors in blocks of their own, so that they don't slow down the others."""
    lists = batch.column("v")
    flat = np.asarray(lists.flatten(), np.float64).reshape(-1, DIM)
    for at in range(0, len(flat), BLOCK):
        part = flat[at : at + BLOCK]
        big = np.abs(part).max(axis=1) >= 2**13  # of such blocks with centroids of the same range 64 * (2 * 2^21)^2 = 2^50 is the bound
        for rows in (np.flatnonzero(~big), np.flatnonzero(big)):
            if len(rows):
                yield at + rows, _whole(part[rows])


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of ties) and its squared distance."""
    d = distances(x, c)
    best = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(c)), key=row.__getitem__) for row in d])
    return best, d[np.arange(len(d)), best]


def _merged(a: dict, b: dict) -> dict:
    """Sums by cluster of two sets of vectors: {cluster: (count, sums)}."""
    for k, (n, s) in b.items():
        m, t = a.get(k, (0, 0))
        a[k] = m + n, t + s
    return a


def _summed(centroids):
    """mapInArrow: one row a task, its sums by cluster."""

    def run(batches):
        total: dict = {}
        for b in batches:
            for _, x in _blocks(b):
                best, _ = _nearest(x, centroids.value)
                for k in np.unique(best).tolist():
                    mine = x[best == k]
                    # Sums of a block in floats if they can't reach 2^53, and integers of any length from there on.
                    small = mine.dtype != object and len(mine) * np.abs(mine).max() < EXACT
                    s = mine.sum(axis=0) if small else _integers(mine).sum(axis=0)
                    _merged(total, {k: (len(mine), _integers(s))})
        yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(total)]})

    return run


def _assigned(centroids):
    """mapInArrow: (vec_id, cluster, distance); a distance beyond 64 bits is null."""

    def run(batches):
        for b in batches:
            cluster, far = np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            for rows, x in _blocks(b):
                best, d = _nearest(x, centroids.value)
                cluster[rows] = best
                for i, v in zip(rows.tolist(), d.tolist()):
                    far[i] = int(v) if v < LONG else None
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector has exactly DIM components, none null or non-finite, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col("v").isNotNull() & (F.size("v") == DIM) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(ok)


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector of df.

    A component x counts as floor(256 x). The first centroids are the vectors with the smallest SHA-256 of `2:<vec_id>`, those of rows that repeat an id by their components,
    a null id last. Each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by floor(sum / count);
    a last assignment follows. distance: squared; cluster_inertia, inertia: its sums over the cluster and over all; centroid_sha256: of the final centroid's components
    in decimal, joined by a comma.

    Vectors that are null, of another length or with null or non-finite components take no part and return no row. Every other row returns one, repeated ones too and those
    of a null id. With fewer vectors than clusters each is a centroid; without any there is no row. A distance or sum beyond 64 bits is null, though assignments stay
    exact. Other columns are left out.
    """
    spark = df.sparkSession
    path = new_path(spark)
    rows = as_table(usable(df, id_col, vec_col), path)
    draw = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(draw.asc_nulls_last(), "v").limit(clusters).collect()
    if not seeds:
        removed(spark, path)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array([[int(x) for x in row] for row in np.concatenate([_whole(np.array([r.v])) for r in seeds]).tolist()], dtype=object)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(now)
        parts = rows.select("v").mapInArrow(_summed(sent), "sums binary").rdd
        total = parts.treeAggregate({}, lambda a, r: _merged(a, pickle.loads(r.sums)), _merged)
        now = np.array([[s // total[k][0] for s in total[k][1]] if k in total else list(c) for k, c in enumerate(now)], dtype=object)
        sent.unpersist()
    out = as_table(rows.mapInArrow(_assigned(spark.sparkContext.broadcast(now)), "vec_id long, cluster int, distance long"))
    removed(spark, path)
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count(F.when(F.col("distance").isNull(), 1)).alias("lost")).collect()
    # A sum with a distance that is null is null.
    exact = {r.cluster: None if r.lost else int(r.s) for r in sums}  # a row for each cluster
    every = None if None in exact.values() else sum(exact.values())
    long = lambda n: n if n is not None and n < LONG else None
    facts = [(k, long(exact.get(k)), long(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(now)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql() -> str:
    """The same by DuckDB: each distance a sum over components, each round a step of its own."""
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (
  SELECT row_id, k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY row_id, k
), a{r} AS MATERIALIZED (
  SELECT row_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY row_id
)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (row_id) GROUP BY k, i
), c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce({floor}, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.i = m.i
)"""
            )
    body = ",\n".join(steps)
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS row_id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (
  SELECT row_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM e, (SELECT unnest(range(1, {DIM + 1})) AS i)
), c0 AS MATERIALIZED (
  SELECT CAST(row_id - 1 AS INTEGER) AS k, i, x FROM v WHERE row_id <= {CLUSTERS}
), {body}, h AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k
)
SELECT vec_id, a.k AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM e JOIN a{ROUNDS} a USING (row_id) JOIN h USING (k)
"""


ORACLE_SQL = oracle_sql()
