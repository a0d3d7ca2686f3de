"""Exact top-k inner products: candidates in order of length, rotated partial sums, Cauchy-Schwarz bounds on the rest.

Candidates are range-partitioned by descending norm and packed into blocks; queries are packed too, each with a score that
k candidates among the longest already reach. A query block meets only the blocks whose longest vector can still reach one
of its scores. Inside a pair of blocks the first rotated components and the norms of the rest bound each product; only what
may reach the score is computed in full, on the whole numbers themselves. The rotation comes from a sample and changes
speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, Window

from riskloom.llm.storage import checkpoint

BLOCK, RUN, HEAD, SAMPLE = 2048, 1024, 2048, 4096
EXACT = 2.0**53  # products of norms below this make every sum of float64 whole numbers exact


def whole_vectors(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v, norm): floor(scale * component) as doubles; rows with a null id or vector, or a component that is null or
    not finite, are left out."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = df.where(F.col(id_column).isNotNull() & x.isNotNull() & fine)
    v = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("double"))
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(flat) else []] = flat
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows; they must fit in 64 bits."""
    if len(q) and np.linalg.norm(q, axis=1).max() * np.linalg.norm(c, axis=1).max() >= EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], dtype=np.int64)
    return np.einsum("ij,ij->i", q, c)


def best_in_blocks(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, score) of each query's k best among c with a score of at least `least`, in runs of candidates."""
    rq, rc = q @ turn, c @ turn
    width = q.shape[1]
    cuts = sorted({max(1, width * part // 8) for part in (1, 2, 4, 6, 8)})
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    rest = [(np.linalg.norm(rq[:, cut:], axis=1), np.linalg.norm(rc[:, cut:], axis=1)) for cut in cuts]
    least = least.copy()
    for at in range(0, len(c), RUN):
        run = slice(at, at + RUN)
        slack = 1e-9 * (q_norm * c_norm[run].max(initial=0.0)) + 1e-6
        going = np.flatnonzero(q_norm * c_norm[run].max(initial=0.0) >= least - slack)
        if not len(going):
            return  # norms descend: no later candidate can reach either
        goal = (least - slack)[going][:, None]
        sums, done = np.zeros((len(going), len(c[run]))), 0
        for cut, (q_rest, c_rest) in zip(cuts, rest, strict=True):
            sums += rq[going, done:cut] @ rc[run, done:cut].T
            done = cut
            open_pairs = np.flatnonzero(sums >= goal - np.outer(q_rest[going], c_rest[run]))
            if len(open_pairs) <= sums.size // 200:
                break
        i, j = np.divmod(open_pairs, sums.shape[1])
        if not len(i):
            continue
        scores = []
        for part in range(0, len(i), 65_536):
            scores.append(_products(q[going[i[part : part + 65_536]]], c[at + j[part : part + 65_536]]))
        score = np.concatenate(scores)
        good = (score >= least[going[i]]) & (q_ids[going[i]] != c_ids[at + j])
        i, j, score = going[i[good]], at + j[good], score[good]
        order = np.lexsort((c_ids[j], -score.astype(np.int64), i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        full = np.flatnonzero(place == k - 1)
        least[i[full]] = np.maximum(least[i[full]], score[full].astype(float))
        top = place < k
        yield q_ids[i[top]], c_ids[j[top]], score[top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query picks, the k best other rows by whole-number inner product.

    Ties go to the smaller id. Rows with null or non-finite components take no part; shorter vectors count as filled with
    zeros. Rows with the query's own id are not its candidates; a repeated query id asks once, with its smallest vector;
    repeated candidates are listed as often as they are there. Fewer than k candidates give fewer rows, no rows none.
    """
    spark = vectors.sparkSession
    rows = checkpoint(whole_vectors(vectors, id_column, vector, scale))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow().column("v")
    _, _, turn = np.linalg.svd(_matrix(sample, width), full_matrices=True)
    turn = turn.T
    head = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("vec_id", "v").toArrow()
    head_ids, head_v = head.column("vec_id").to_numpy(), _matrix(head.column("v"), width)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(np.linalg.norm(v[0]))]), pa.array([ids.tobytes()]), pa.array([v.tobytes()])],
                                              ["part", "longest", "ids", "v"])

        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            for at in range(0, len(ids), BLOCK):
                held.append((ids[at : at + BLOCK], v[at : at + BLOCK]))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    ordered = rows.select("vec_id", "v", F.col("norm").alias("length")).repartitionByRange(partitions, F.desc("length"), "vec_id")
    blocks = checkpoint(ordered.sortWithinPartitions(F.desc("length"), "vec_id").select("vec_id", "v").mapInArrow(
        pack, "part int, longest double, ids binary, v binary"))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, q = part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)
                scores = q @ head_v.T
                scores[ids[:, None] == head_ids[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(head_ids) > k else np.full(len(ids), -np.inf)
                norms = np.linalg.norm(q, axis=1)
                least = np.where(np.isfinite(least), least - 1e-9 * np.abs(least), -np.inf)
                need = np.where(norms > 0, least / np.maximum(norms, 1e-300), np.where(least > 0, np.inf, -np.inf)).min()
                yield pa.RecordBatch.from_arrays([pa.array([float(need)]), pa.array([ids.tobytes()]), pa.array([q.tobytes()]), pa.array([least.tobytes()])], ["need", "q_ids", "q", "least"])

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    packed = checkpoint(queries.mapInArrow(pack_queries, "need double, q_ids binary, q binary, least binary"))
    longest = blocks.groupBy("part").agg(F.max("longest").alias("most"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                q, v = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, width) for c in ("q", "v"))
                least = np.frombuffer(batch.column("least")[row].as_buffer(), np.float64)
                for a, b, score in best_in_blocks(q_ids, q, least, ids, v, k, turn):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    limits = {r["part"]: r["most"] for r in longest.collect()}  # one number for each shuffle partition
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(m).alias("most")) for p, m in sorted(limits.items())])
    wanted = packed.withColumn("at", F.explode(F.filter(parts, lambda p: p["most"] >= F.col("need") - 1e-6))).select("*", F.col("at.part").alias("part")).drop("at")
    pairs = wanted.join(blocks, "part").where(F.col("longest") >= F.col("need") - 1e-6).select("q_ids", "q", "least", "ids", "v")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
