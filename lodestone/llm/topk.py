"""Exact top-k by inner product over buckets of equal length.

Vectors are grouped by norm. A query's score in the longest vectors gives a
score to beat; with a bucket's greatest norm it becomes a least cosine for the
bucket. Above one, the bucket is left out; if high, vectors are pruned by the
range that the cosine leaves to the query's largest coordinates, otherwise by
their length; what stays is multiplied out. Vectors are shuffled once, whatever
the number of queries, which stream past a block of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored
from .vectors import dealt, matrix, to_all_blocks, usable, width_of

BUCKETS, BLOCK, SEEDS = 32, 16_384, 2048
#: From this local cosine on, coordinates prune; below it, lengths do. How many coordinates.
COSINE, FOCUS = 0.25, 4


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, in floating point only where that is exact."""
    most = np.abs(x).sum(1).max(initial=0) * float(np.abs(q).max(initial=0))
    if most < 2**52:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def survivors(unit: np.ndarray, norm: np.ndarray, query: np.ndarray, beat: float) -> np.ndarray:
    """Rows of a bucket that may score at least ``beat`` against the query."""
    size = float(np.linalg.norm(query))
    if size == 0 or beat == -np.inf:
        return np.arange(len(norm))
    cosine = beat / (size * norm.max(initial=0) + 1e-300)
    if cosine > 1 + 1e-9:
        return np.zeros(0, np.int64)
    stay = np.flatnonzero(norm * size >= beat * (1 - 1e-12) - 1e-9) if beat > 0 else np.arange(len(norm))
    if cosine >= COSINE:
        direction = query / size
        for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
            middle = direction[f] * cosine
            reach = np.sqrt(max(0.0, (1 - min(cosine, 1.0) ** 2) * (1 - direction[f] ** 2)))
            # The least cosine is an upper cap only on the query's side: on the other, more cosine reaches further.
            low, high = (middle - reach, 1.0) if direction[f] > 0 else (-1.0, middle + reach)
            if abs(direction[f]) < cosine:
                low, high = middle - reach, middle + reach
            x = unit[stay, f]
            stay = stay[(x >= low - 1e-9) & (x <= high + 1e-9)]
    return stay


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to the smaller id.

    Components become floor(scale * x) in double precision. Queries are the
    rows where ``is_query`` holds, once for each id, of rows that share one the
    least vector by its components; candidates are all rows of another id, so an
    id that comes up twice is never its own partner but may be listed twice.
    Rows without an id and vectors that are null or hold null, NaN or infinity
    take no part; shorter ones count as filled up with zeros. Fewer candidates than
    ``k`` are all listed; an empty table gives no rows. Products must fit a long.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    width = width_of(rows, "v")
    whole = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("bigint"))
    whole = F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))
    items = stored(rows.select("id", "asks", whole.alias("x")).withColumn("norm", norm), "items")

    spark = vectors.sparkSession
    seeds = items.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "x").collect()
    shared = spark.sparkContext.broadcast((np.array([r.id for r in seeds], np.int64), np.array([r.x for r in seeds], np.int64).reshape(len(seeds), width)))

    def to_beat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            q, own = matrix(batch.column("x"), width), batch.column("id").to_numpy()
            got = scores(q, x).astype(float)
            got[own[:, None] == ids[None]] = -np.inf
            beat = np.partition(got, -k, axis=1)[:, -k] if got.shape[1] >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beat)], [*batch.schema.names, "beat"])

    # Bucket 0 is the longest. Limits are norms; equal ones fall together.
    limits = sorted({float(x) for x in items.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01)}, reverse=True)
    bucket = F.lit(0)
    for limit in limits:
        bucket = bucket + F.when(F.col("norm") < limit, 1).otherwise(0)
    members, blocks = dealt(items.select("id", "x", "norm", bucket.alias("bucket")), "bucket", "id", BLOCK, "block")
    longest = {r.bucket: r.most for r in members.groupBy("bucket").agg(F.max("norm").alias("most")).collect()}
    once = items.where("asks").groupBy("id").agg(F.min(F.struct("x", "norm")).alias("q")).select("id", "q.x", "q.norm")
    asked = once.mapInArrow(to_beat, "id bigint, x array<bigint>, norm double, beat double")
    tops = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(most).alias("most")) for b, most in sorted(longest.items())]) if longest else F.array(F.struct(F.lit(0).alias("bucket"), F.lit(0.0).alias("most"))) 
    worth = F.filter(tops, lambda b: F.col("norm") * b["most"] >= F.col("beat") * F.lit(1 - 1e-12) - F.lit(1e-6))
    asked = asked.withColumn("bucket", F.explode(F.transform(worth, lambda b: b["bucket"])))
    asked = to_all_blocks(stored(asked, "asked"), "bucket", blocks, "block")
    keys = ["bucket", "block", "kind"]
    members = members.withColumns({"kind": F.lit(0), "beat": F.lit(None).cast("double")})
    both = members.unionByName(asked.withColumn("kind", F.lit(1))).repartition(partitions_for(vectors), "bucket", "block").sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []  # the block that is read, and its members
        for batch in batches:
            told = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            cuts = [0, *(np.flatnonzero((told[1:] != told[:-1]).any(1)) + 1).tolist(), len(told)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                part, block = batch.slice(start, end - start), tuple(told[start, :2].tolist())
                if block != here:
                    here, held, block_of = block, [], None
                if told[start, 2] == 0:
                    held.append((matrix(part.column("x"), width), part.column("id").to_numpy(), part.column("norm").to_numpy()))
                elif held:
                    if block_of is None:
                        block_of = [np.concatenate(list(c)) for c in zip(*held, strict=True)]
                    yield ask(*block_of, part)

    def ask(x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, queries: pa.RecordBatch) -> pa.RecordBatch:
        unit, out = x / np.maximum(sizes, 1e-300)[:, None], []
        for q, own, beat in zip(matrix(queries.column("x"), width), queries.column("id").to_pylist(), queries.column("beat").to_pylist(), strict=True):
            stay = survivors(unit, sizes, q, beat)
            stay = stay[ids[stay] != own]
            if len(stay):
                score = scores(x[stay], q[None])[:, 0]
                at = best(score, ids[stay], k)
                out += [(own, int(i), int(s)) for i, s in zip(ids[stay][at], score[at], strict=True)]
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(a[:, c]) for c in range(3)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
