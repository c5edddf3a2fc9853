"""Approximate nearest neighbours: a navigable graph per shard, shard results merged.

Rows are dealt into bounded shards by a hash of their id, so copies of one vector are
spread; inside a shard copies are one node with a list of ids.  A shard's graph is
one row of flat arrays, built once and written down.  Blocks of queries meet every
shard; what a shard finds is measured again in double precision on the original vectors,
and the best of all shards remain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.llm import hnsw
from postweave.llm.common import read_table, written

NEAREST = 20
SHARD = 8192
QUERIES = 512
#: Blocks of queries that one task takes to a shard.
BLOCKS = 16

_INDEX = (
    "size int, shard long, vectors binary, ids binary, edges binary, "
    "nodes array<binary>, neighbours array<binary>"
)
_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, one not zero."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def shard_numbers(rows: DataFrame, shard_rows: int = SHARD) -> Column:
    """How many shards the vectors of length ``size`` have."""
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().collect()
    shards = F.lit(0)
    for row in sizes:
        shards = F.when(F.col("size") == row["size"], -(-row["count"] // shard_rows)).otherwise(shards)
    return shards.cast("long")


def build_index(rows: DataFrame, shards: Column) -> DataFrame:
    """One row per shard of ``rows(vec_id, embedding)``; vectors of different lengths are
    sharded apart."""
    sized = rows.withColumn("size", F.size("embedding"))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards))

    def build(group: pa.Table) -> pa.Table:
        size, shard = group.column("size")[0].as_py(), group.column("shard")[0].as_py()
        x = _matrix(group.column("embedding"), size)
        ids = group.column("vec_id").to_numpy()
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.append(True, (x[1:] != x[:-1]).any(1))
        # A row that repeats id and vector counts once.
        keep = new | np.append(True, ids[1:] != ids[:-1])
        x, ids, new = x[keep], ids[keep], new[keep]
        vectors, edges = x[new], np.append(np.flatnonzero(new), len(ids)).astype(np.int64)
        # In no order of their components, so that near ones are not inserted together.
        shuffle = np.random.default_rng(9).permutation(len(vectors))
        graph = hnsw.build(vectors[shuffle])
        nodes = [n.astype(np.int32).tobytes() for n in graph.nodes]
        links = [n.astype(np.int32).tobytes() for n in graph.neighbours]
        counts = np.diff(edges)[shuffle]
        members = np.concatenate([ids[edges[i] : edges[i + 1]] for i in shuffle])
        row = {
            "size": size,
            "shard": shard,
            "vectors": vectors[shuffle].tobytes(),
            "ids": members.tobytes(),
            "edges": np.append(0, np.cumsum(counts)).astype(np.int64).tobytes(),
            "nodes": nodes,
            "neighbours": links,
        }
        return pa.Table.from_pylist([row], schema=_INDEX_ARROW)

    return written(dealt.groupBy("size", "shard").applyInArrow(build, _INDEX), "index")


_INDEX_ARROW = pa.schema(
    [
        ("size", pa.int32()),
        ("shard", pa.int64()),
        ("vectors", pa.binary()),
        ("ids", pa.binary()),
        ("edges", pa.binary()),
        ("nodes", pa.list_(pa.binary())),
        ("neighbours", pa.list_(pa.binary())),
    ]
)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def search_shard(index: dict, ids: np.ndarray, x: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query ids, vector ids, scores)``: up to ``nearest`` of the shard for each query,
    copies and ties by id; rows with the query's own id are left out."""
    size = x.shape[1]
    vectors = np.frombuffer(index["vectors"], x.dtype).reshape(-1, size)
    members, edges = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["edges"], np.int64)
    nodes = [np.frombuffer(n, np.int32) for n in index["nodes"]]
    links = [np.frombuffer(n, np.int32).reshape(len(k), -1) for n, k in zip(index["neighbours"], nodes)]
    graph = hnsw.Graph(hnsw.lengthened(vectors), nodes, links)
    exact = vectors.astype(np.float64)
    out = [], [], []
    for at in range(0, len(x), hnsw.BLOCK):
        some = x[at : at + hnsw.BLOCK]
        found = hnsw.search(graph, some)
        scores = (exact[np.maximum(found, 0)] * some.astype(np.float64)[:, None, :]).sum(2)
        for query, row, score in zip(ids[at : at + hnsw.BLOCK], found, scores):
            row, score = row[row >= 0], score[row >= 0]
            many = edges[row + 1] - edges[row]
            order = np.argsort(-score, kind="stable")
            # Vectors enough to fill the list even after the query's own id, with their ties.
            enough = int(np.searchsorted(np.cumsum(many[order]), nearest + 1)) + 1
            if enough < len(order):
                enough = int((score >= score[order[enough - 1]]).sum())
            order = order[:enough]
            v = np.concatenate([members[edges[r] : edges[r + 1]] for r in row[order]] or [members[:0]])
            s = np.repeat(score[order], many[order])
            s, v = s[v != query], v[v != query]
            best = np.lexsort((v, -s))[:nearest]
            out[0].append(np.full(len(best), query))
            out[1].append(v[best])
            out[2].append(s[best])
    return tuple(np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, (np.int64, np.int64, np.float64)))


def nearest(rows: DataFrame, queries: DataFrame, many: int = NEAREST, shard_rows: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``many`` nearest found of ``rows`` for each of
    ``queries``, both ``(vec_id, embedding)``, by inner product, ties to the smaller id.

    Vectors that are null, empty or zero, or hold a null or non-finite component, take no
    part on either side, nor do rows without id.  Copies are all found.  Rows that
    repeat an id and vector count once; a query id given twice is asked once, with its
    smallest vector.  Queries meet vectors of their own length.  Other columns are
    not read; an empty table gives no rows.
    """
    chosen = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding"
    )
    shards = shard_numbers(chosen(rows), shard_rows)
    index = build_index(chosen(rows), shards)
    asked = chosen(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumn("size", F.size("embedding"))
    n = asked.count()
    groups = max(1, -(-n // (QUERIES * BLOCKS)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(groups)))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(BLOCKS))), "queries")

    def pack(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("embedding"), group.column("size")[0].as_py())
        return pa.table(
            {
                "size": group.column("size").slice(0, 1),
                "part": group.column("part").slice(0, 1),
                "asked": [group.column("vec_id").to_numpy().tobytes()],
                "points": [x.tobytes()],
            }
        ).cast(pa.schema([("size", pa.int32()), ("part", pa.int64()), ("asked", pa.binary()), ("points", pa.binary())]))

    packed = asked.groupBy("size", "part", "block").applyInArrow(pack, "size int, part long, asked binary, points binary")
    # Blocks go to the shards, which are larger; a shard goes once to each part of the blocks.
    sent = packed.where(shards > 0).select(
        F.col("size").alias("to_size"),
        F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("to_shard"),
        F.col("part").alias("to_part"),
        "asked",
        "points",
    )
    shown = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    kind = np.float64 if "double" in rows.schema["embedding"].dataType.simpleString() else np.float32

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            for ids, points in zip(right.column("asked").to_pylist(), right.column("points").to_pylist()):
                x = np.frombuffer(points, kind).reshape(-1, row["size"])
                found.append(search_shard(row, np.frombuffer(ids, np.int64), x, many))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, k) for k in (np.int64, np.int64, np.float64)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    keys = ("size", "shard", "part")
    found = shown.groupBy(*keys).cogroup(sent.groupBy(*(f"to_{k}" for k in keys))).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
