"""Operator 10, exact top-k search with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). Queries and candidates meet in tiles:
one block of queries and one part of the candidates, both of bounded size, so a
tile fits in a task whatever the tables have. In a tile every vector is described
by the mean and the deviation of its segments, first of a few long ones, then of
more short ones. They give a lower bound of the distance and with the lengths an
upper bound of the inner product,

    d^2 >= sum over segments of  L (m_q - m_v)^2 + (s_q - s_v)^2.

Candidates whose bound stays below the k-th best exact score known so far are
dropped, coarse to fine; the others are computed exactly. The k best of each tile
are merged to the k best of the query.

Null vectors, and those with a null or non-finite component, take no part, nor do
rows without an id. Only vectors of equal length are compared. Equal scores go to
the smaller id. Every row is its own query or candidate, also where an id is
repeated; a query never meets rows of its own id. Scores beyond 64 bits are set
to the nearest long before they are ranked; vectors whose length is 0 score 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

K, SCALE, EVERY = 10, 1024, 100
TILE_QUERIES, TILE_ROWS, TILE_BYTES = 8_192, 8_192, 64_000_000
SEGMENTS = (4, 16)
CHUNK = 128
_EXACT = float(2**52)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if dim == 0:
        return np.zeros((len(column), 1))
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(column), dim)


def _stats(v: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of each row's segments, side by side."""
    pad = -v.shape[1] % segments
    parts = np.pad(v, ((0, 0), (0, pad))).reshape(len(v), segments, -1)
    mean = parts.mean(axis=2)
    spread = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.hstack([mean * np.sqrt(parts.shape[2]), spread])


def _bounds(q: np.ndarray, v: np.ndarray, q_norm: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products from the lower bounds of the distances."""
    least = (q**2).sum(-1)[..., None] + (v**2).sum(-1) - 2 * (q @ v.swapaxes(-1, -2))
    most = (q_norm[..., None] + v_norm - least) / 2
    return most + 1 + 1e-9 * np.sqrt(q_norm[..., None] * v_norm)


def tile_top(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, candidate positions and exact scores of the k best of every query."""
    if not len(v) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        exact = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < _EXACT
    if not exact:
        return _big_top(q, q_ids, v, v_ids, k)
    coarse, fine = (_stats(v, s) for s in SEGMENTS)
    v_norm = (v**2).sum(axis=1)
    rows, cols, scores = [], [], []
    for lo in range(0, len(q), CHUNK):
        part, ids = q[lo : lo + CHUNK], q_ids[lo : lo + CHUNK]
        q_norm = (part**2).sum(axis=1)
        q_coarse, q_fine = (_stats(part, s) for s in SEGMENTS)
        most = _bounds(q_coarse, coarse, q_norm, v_norm)
        own = ids[:, None] == v_ids
        most[own] = -np.inf
        tried = np.argpartition(-most, min(4 * k, most.shape[1] - 1), axis=1)[:, : 4 * k]
        first = np.einsum("qd,qcd->qc", part, v[tried])
        first[np.take_along_axis(own, tried, 1)] = -np.inf
        edge = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(part), -np.inf)
        for i in range(len(part)):
            left = np.flatnonzero((most[i] >= edge[i]) & ~own[i])
            if len(left) > 4 * k:
                near = _bounds(q_fine[i], fine[left], q_norm[i], v_norm[left])
                left = left[near.ravel() >= edge[i]]
            score = (v[left] @ part[i]).astype(np.int64)
            best = np.lexsort((v_ids[left], -score))[:k]
            rows.append(np.full(len(best), lo + i))
            cols.append(left[best])
            scores.append(score[best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _big_top(q, q_ids, v, v_ids, k):
    """The same for components beyond the exact range of doubles, with whole numbers of any size."""
    rows, cols, scores = [], [], []
    whole = [[int(x) for x in row] for row in v.tolist()]
    for i, row in enumerate(q.tolist()):
        query = [int(x) for x in row]
        found = []
        for j, other in enumerate(whole):
            if v_ids[j] != q_ids[i]:
                score = sum(a * b for a, b in zip(query, other, strict=True))
                found.append((-max(-(2**63), min(2**63 - 1, score)), int(v_ids[j]), j))
        for score, _, j in sorted(found)[:k]:
            rows.append(i)
            cols.append(j)
            scores.append(-score)
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(scores, np.int64)


def search(vectors: DataFrame, every: int = EVERY, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row whose id is divisible by ``every``."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).withColumn("dim", F.size("x"))
    is_query = F.col("vec_id") % every == 0
    # A tile is bounded in rows and, for wide vectors, in bytes.
    n, wide, asked, wide_asked = rows.agg(
        F.count(F.lit(1)), F.sum("dim"), F.count(F.when(is_query, 1)), F.sum(F.when(is_query, F.col("dim")))
    ).first()
    parts = max(1, -(-n // TILE_ROWS), -(-8 * (wide or 0) // TILE_BYTES))
    blocks = max(1, -(-asked // TILE_QUERIES), -(-8 * (wide_asked or 0) // TILE_BYTES))
    key = F.xxhash64("vec_id", "x")
    candidates = rows.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Rows that repeat id and vector ask the same: they are searched once and answered each.
    queries = (
        rows.where(is_query)
        .groupBy("vec_id", "x", "dim")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("query", key)
        .withColumn("block", F.pmod(key, F.lit(blocks)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query", "copies", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        left, right = left.combine_chunks(), right.combine_chunks()
        dim = left["dim"][0].as_py()
        q_ids, v_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, v = (_vectors(t["x"].combine_chunks(), dim) for t in (left, right))
        a, b, score = tile_top(q, q_ids, v, v_ids, k)
        return pa.table({"query_id": q_ids[a], "query": left["query"].to_numpy()[a], "copies": left["copies"].to_numpy()[a], "vec_id": v_ids[b], "score": score})

    keys = ("dim", "block", "part")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile, "query_id long, query long, copies long, vec_id long, score long")
    order = "row_number() over (partition by query_id, query order by score desc, vec_id)"
    best = found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
