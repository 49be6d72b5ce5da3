"""Exact top-k search by multi-resolution segment statistics.

A vector is described by the mean and deviation of its segments, at several resolutions.  By
the inequality of Cauchy and Schwarz on each segment, the squared distance of two vectors is
at least the sum of ``length * ((mean - mean')^2 + (deviation - deviation')^2)``, so with the
norms known their inner product is at most ``length * (mean * mean' + deviation * deviation')``
summed over the segments.  Candidates are tested from the coarsest resolution to the finest
against the k-th best score so far; survivors get their exact integer score.

Queries and candidates are packed into blocks of rows; each pair of blocks is one unit of work
that keeps k rows per query, and these are merged per query.  Vectors that are null, that hold
a null or a number that is not finite take no part, nor do rows without an id.  Candidates of
other lengths than the query's are not comparable and are left out.  Ties go to the smaller id;
rows that repeat an id each count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
_BLOCK = "dim int, n int, ids binary, data binary"


def usable(vector: Column) -> Column:
    """Whether every component is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def pack(vectors: DataFrame, rows: int, id_col: str, vector_col: str) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length, floored to integers, in binary columns."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches):
        open_blocks: dict[int, list] = {}

        def close(dim):
            ids, data = zip(*open_blocks.pop(dim), strict=True)
            return pa.RecordBatch.from_pylist(
                [{"dim": dim, "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "data": b"".join(data)}], schema
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                block = open_blocks.setdefault(len(x), [])
                block.append((i, np.floor(SCALE * x).astype("<i8").tobytes()))
                if len(block) == rows:
                    yield close(len(x))
        for dim in list(open_blocks):
            yield close(dim)

    chosen = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    return chosen.select(F.col(id_col).cast("bigint"), F.col(vector_col)).mapInArrow(run, _BLOCK)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row means and deviations of the segments, scaled so that a product of two rows is a bound."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            root = np.sqrt(b - a)
            parts += [x[:, a:b].mean(1) * root, x[:, a:b].std(1) * root]
    return np.array(parts).T.reshape(len(x), -1)


def unpack(n: int, dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(n, dim)


def search_blocks(
    queries: tuple[np.ndarray, np.ndarray],
    candidates: tuple[np.ndarray, np.ndarray],
    k: int,
    resolutions: tuple[int, ...] = (1, 4, 16),
) -> list[tuple[int, int, int, int]]:
    """(query_id, row of the query, vec_id, score): the k best candidates of each query."""
    q_ids, q = queries
    c_ids, c = candidates
    q_float, c_float = q.astype(np.float64), c.astype(np.float64)
    levels = [(statistics(q_float, s), statistics(c_float, s)) for s in resolutions if s <= max(q.shape[1], 1)]
    slack = 1e-9 * (np.linalg.norm(q_float, axis=1)[:, None] * np.linalg.norm(c_float, axis=1)[None, :] + 1)
    coarse = levels[0][0] @ levels[0][1].T + slack
    found = []
    for i in range(len(q_ids)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        if not len(alive):
            continue
        if len(alive) > k:
            # A first k-th best score, from the candidates of the largest coarse bounds.
            first = alive[np.argpartition(-coarse[i, alive], k - 1)[: 4 * k]]
            least = np.partition(c[first] @ q[i], len(first) - k)[len(first) - k]
            alive = alive[coarse[i, alive] >= least]
            for q_stats, c_stats in levels[1:]:
                bound = c_stats[alive] @ q_stats[i] + slack[i, alive]
                alive = alive[bound >= least]
        score = c[alive] @ q[i]
        best = np.lexsort((c_ids[alive], -score))[:k]
        found += [(int(q_ids[i]), i, int(c_ids[alive[j]]), int(score[j])) for j in best]
    return found


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    query_rows: int = 256,
    candidate_rows: int = 4096,
    shares: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    The candidate blocks are dealt into ``shares`` groups; every query block is sent to each
    group once, so a query's data is copied ``shares`` times, however many candidates there
    are.  Every row of ``queries`` is answered by itself, also where ids repeat.
    """
    blocks = pack(vectors, candidate_rows, id_col, vector_col)
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    asked = pack(queries, query_rows, id_col, vector_col)
    asked = asked.toDF("dim", "q_n", "q_ids", "q_data").withColumn("block", F.monotonically_increasing_id())
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    pairs = asked.join(dealt, ["share", "dim"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                rows = search_blocks(
                    unpack(r["q_n"], r["dim"], r["q_ids"], r["q_data"]), unpack(r["n"], r["dim"], r["ids"], r["data"]), k
                )
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * len(rows), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]],
                    names=["block", "query_id", "row", "vec_id", "score"],
                )

    columns = "dim", "block", "q_n", "q_ids", "q_data", "n", "ids", "data"
    found = pairs.select(*columns).mapInArrow(run, "block bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("block", "row", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
