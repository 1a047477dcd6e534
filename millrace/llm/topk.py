"""Exact top-k inner-product search in tiles.

Queries are cut into blocks of at most BLOCK rows, broadcast one block a pass (BLOCK rows of a fixed dimension: a bounded
size). In a pass every task multiplies the block with one tile of vectors after another, keeps k candidates a query from
each tile by partial selection, and writes one list a query; the next block is fetched when a pass has ended. Lists of all
passes are then merged in a tree, FAN tasks at a time.

Edge cases: a vector that is null or holds null or non-finite components takes no part; vectors meet those of equal
length only; a vec_id that is null takes no part; repeated rows count once, and of several vectors under one queried
vec_id the least is the query; a row of the query's own vec_id is no candidate; ties go to the smaller id; an empty table, or
one without queries, gives no rows; other columns of the input are not looked at. Scores are exact: in doubles while they
stay below 2**53, else in Python's integers, then held to the range of a long.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, ship

K = 5
SCALE = 256
BLOCK = 4096
TILE = 4096
FAN = 16
LISTS = "node int, query_id long, best array<struct<s: long, id: long>>"


def sound_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the vector as doubles; only rows that take part. Components are scaled within the tiles."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(sound).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        if len(at) > 4 * k:  # ties: of the least score only the smallest ids can count
            over, tied = at[scores[at] > least], at[scores[at] == least]
            at = np.concatenate([over, tied[np.argpartition(ids[tied], min(k, len(tied)) - 1)[:k]]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k].tolist()


def _matrix(column, scale: int) -> tuple[np.ndarray, int]:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), -1), len(column)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integers held in doubles, as int64."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    out = big(q).dot(big(v).T) if q.size and v.size else np.zeros((len(q), len(v)), object)
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def _searcher(block, k: int, scale: int, tile: int):
    """For each task: node, query_id and its best candidates as parallel lists."""

    def search(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        by_size = block.value
        top = {n: ([[] for _ in ids]) for n, (ids, _) in by_size.items()}
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for n in np.unique(sizes):
                if n not in by_size:
                    continue
                part = batch.filter(pa.array(sizes == n))
                queries, q = by_size[n]
                for at in range(0, part.num_rows, tile):
                    piece = part.slice(at, tile)
                    ids = np.asarray(piece.column(0))
                    v, _ = _matrix(piece.column(1), scale)
                    # Rows are compared by ids as integers and vectors by their bits; adding zero leaves one kind of zero.
                    _, once = np.unique(np.column_stack([ids, (v + 0.0).view(np.int64)]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (0, slice(None))
                    ids, v = ids[once], v[once]
                    order = np.argsort(ids, kind="stable")
                    ids, v = ids[order], v[order]
                    for lo in range(0, len(queries), 256):
                        scores = _exact(q[lo : lo + 256], v)
                        for i, row in enumerate(scores):
                            own = queries[lo + i]
                            a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                            got, s = (np.delete(ids, slice(a, b)), np.delete(row, slice(a, b))) if b > a else (ids, row)
                            have = top[n][lo + i]
                            if len(have) == k:
                                keep = s >= have[-1][0]
                                if not keep.any():
                                    continue
                                got, s = got[keep], s[keep]
                            found = {(int(s[j]), int(got[j])) for j in _best(s, got, k)}
                            top[n][lo + i] = sorted(found.union(have), key=lambda x: (-x[0], x[1]))[:k]
        rows = [(node, int(own), have) for n, (ids, _) in by_size.items() for own, have in zip(ids, top[n]) if have]
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            best = pa.array([[{"s": -s, "id": i} for s, i in h] for _, _, h in part], pa.list_(pa.struct([("s", pa.int64()), ("id", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), best], ["node", "query_id", "best"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; both frames as from ``sound_vectors``."""
    spark: SparkSession = vectors.sparkSession
    q = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")).repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "queries")
    blocks = max(1, -(-q.count() // BLOCK))
    cut = [None] if blocks == 1 else [None, *q.approxQuantile("vec_id", [i / blocks for i in range(1, blocks)], 0.0)]
    tasks, path = vectors.rdd.getNumPartitions(), f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    for n, (lo, hi) in enumerate(zip(cut, [*cut[1:], None])):
        own = q.filter((F.lit(True) if lo is None else F.col("vec_id") >= F.lit(int(lo))) & (F.lit(True) if hi is None else F.col("vec_id") < F.lit(int(hi)))).toArrow()
        sizes = np.asarray(own.column("v").combine_chunks().value_lengths()) if own.num_rows else np.zeros(0, int)
        by_size = {}
        for size in np.unique(sizes):
            part = own.filter(pa.array(sizes == size)).combine_chunks()
            by_size[int(size)] = (np.asarray(part.column("vec_id")), _matrix(part.column("v").combine_chunks(), scale)[0])
        # Each pass writes its lists; only then is the next block fetched, and the driver and the executors let go of this one.
        block = spark.sparkContext.broadcast(by_size)
        ship(vectors).mapInArrow(_searcher(block, k, scale, TILE), LISTS).write.parquet(f"{path}/block={n}")
        block.destroy()
    lists = spark.read.schema(LISTS).parquet(path)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k)
        lists = lists.groupBy("query_id", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(merged.alias("best"))
    rows = lists.select("query_id", F.posexplode("best").alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op8_topk(spark, sf_dir: str) -> DataFrame:
    v = sound_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0))
