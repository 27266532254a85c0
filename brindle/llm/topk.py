"""Exact top-k inner products by the threshold algorithm.

Candidates lie in blocks. A block sorts its candidates once for each dimension. A query walks the lists of all its dimensions
downwards from the end that its sign favours, a step of several positions at a time, scores the candidates it meets for the
first time in full, and stops when the sum of the products at the current depth (no unmet candidate of the block can score
more) is less than its kth score. At equality it goes on, as an unmet candidate of a smaller id could tie. A query starts with
a bound: its kth score among SAMPLE candidates, which the kth score of all can't be less than. The blocks' best that reach
the bound meet in one window for each query.

Queries are a stated set, held against all rows in blocks: a query goes to every block, a candidate to one. A task reads a
block's candidates, then its queries batch by batch, so it never holds more than a block and a batch.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do those with a
component so large that a score might not fit in a long (1024 * |x| at or above the root of 2^63 / length); only vectors of
equal length are scored together; candidates of repeated ids are rows of their own (a query skips the rows that carry its own
id), and of query rows that share id and length the smallest vector asks; ties go to the smaller id; null ids take no part; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates on average, and candidates that give queries their first bound.
BLOCK_ROWS, SAMPLE = 4096, 512


class Block:
    """Candidates of one length with their sorted lists."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.lists, axis=0)
        self.widest = int(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)
        self.exact = vectors.astype(np.float64)

    def best(self, query: np.ndarray, own: int, k: int, least: int | None = None, step: int = 64) -> list[tuple[int, int]]:
        """(score, id) of the k best but for the rows of id own, ties to smaller ids; those below least may be left out."""
        n = len(self.ids)
        # doubles are exact below 2^53
        exact = self.widest * int(np.abs(query).max(initial=0)) < 1 << 53
        table = self.exact if exact else self.vectors
        query = query.astype(table.dtype)
        used = np.flatnonzero(query)
        down = query[used] > 0
        met = self.ids == own
        found: list[tuple[int, int]] = []
        at = 0
        while at < n:
            to = min(n, at + step)
            rows = np.where(down[None, :], self.lists[n - to : n - at, used][::-1], self.lists[at:to, used]).ravel() if len(used) else np.arange(n)
            new = np.unique(rows[~met[rows]])
            met[new] = True
            scores = table[new] @ query
            if least is not None:
                new, scores = new[scores >= least], scores[scores >= least]
            if len(new):
                found = sorted([*found, *zip((int(s) for s in scores), self.ids[new].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                if len(found) == k:
                    least = found[-1][0] if least is None else max(least, found[-1][0])
            if not len(used):
                break
            if least is not None:
                edge = np.where(down, self.sorted[n - to, used], self.sorted[to - 1, used]).astype(table.dtype)
                if (edge * query[used]).sum() < least:
                    break
            at = to
        return found


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    most = F.sqrt(F.lit(2.0**63) / F.size(vector))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < most - 1))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score of each query row's k highest scores among all other rows. is_query: a condition on df's columns."""
    rows = df.select(F.col(id_col).alias("id"), whole(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("dims", F.size("v"))
    blocks = max(1, -(-rows.count() // block_rows))
    seen: dict[int, Block] = {}
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("id", "v", "dims").toPandas()  # SAMPLE rows
    for dims, own in sample.groupby("dims"):
        seen[dims] = Block(np.array(own.v.tolist(), dtype=np.int64), own.id.to_numpy(dtype=np.int64))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least: list[int | None] = []
            for i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                best = seen[len(v)].best(np.array(v, dtype=np.int64), i, k) if len(v) in seen else []
                least.append(best[-1][0] if len(best) == k else None)
            yield pa.record_batch([*b.columns, pa.array(least, pa.int64())], names=["dims", "id", "v", "least"])

    # blocks by the hash of the whole row: copies of one vector are spread too
    held = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "dims", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("least"))
    asks = rows.where("asks").groupBy("dims", "id").agg(F.min("v").alias("v")).mapInArrow(bounded, "dims int, id long, v array<long>, least long")
    asks = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "dims", F.lit(1).alias("kind"), "id", "v", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for b in batches:
            place = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                some, key = b.slice(start, end - start), (place[0, start], place[1, start])
                if key != at:
                    at, parts, block = key, [], None
                ids, vectors = some.column(3).to_numpy(), _matrix(some.column(4), int(key[1]))
                if place[2, start] == 0:
                    parts.append((ids, vectors))
                elif parts:
                    if block is None:
                        block = Block(np.concatenate([x[1] for x in parts]), np.concatenate([x[0] for x in parts]))
                    out = [(i, x, s) for i, v, least in zip(ids.tolist(), vectors, some.column(5).to_pylist()) for s, x in block.best(v, i, k, least)]
                    if out:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["query_id", "id", "score"])

    dealt = held.unionByName(asks).repartition("block").sortWithinPartitions("block", "dims", "kind", "id")
    found = dealt.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
