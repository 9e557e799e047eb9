"""Nearest neighbours by inner product: a robust-pruned graph for each shard, beam search of every query in every shard.

Equal vectors are one node with their smallest ids, as many as a result can hold, so that copies neither crowd a graph nor
are lost at ties. Nodes are dealt into shards by hash; a shard has about ``shard_size`` nodes at any table size. Inside a
shard one more component makes all vectors equally long, which turns the largest inner product into the smallest distance.
Each shard's graph is built once and written as one row. Queries are dealt into blocks by hash, about ``query_block`` in each;
a group holds one graph and one block, so no group grows with the table. Every query's beams are merged; scores are inner
products of the original vectors in double precision.

Vectors that are null, zero, empty, of another length than most, or hold nulls or non-finite numbers take no part, nor do
rows without an id. Equal scores go by the smaller id. A query with fewer candidates than ``k`` gets them all. An empty table,
or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectus.llm.common import cut, stored
from prospectus.llm.graph import Graph, beam_search, built

#: A shard's graph as one row: arrays as bytes, rows in the graph's order; the ids of row i end at ``ends[i]``.
GRAPH = "shard int, length int, own binary, vectors binary, edges binary, entries binary, ids binary, ends binary"


def usable(vector: Column) -> Column:
    """The vector is not null, has a component other than zero, and none that is null or not finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def whole_vectors(rows: DataFrame, *more: str) -> DataFrame:
    """Usable rows as ``vec_id``, ``embedding`` (doubles) and ``more``; of the length that most vectors have."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *more)
    kept = kept.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = kept.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1)
    found = lengths.collect()
    return kept.where(F.size("embedding") == (found[0]["length"] if found else 0))


def neighbours(
    rows: DataFrame,
    queries: Column,
    k: int = 20,
    shard_size: int = 8192,
    query_block: int = 16384,
    degree: int = 32,
    build_beam: int = 64,
    beam: int = 96,
    alpha: float = 1.2,
) -> DataFrame:
    """The ``k`` nearest of each row that ``queries`` (a condition on ``vec_id``) selects, among all other rows.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.
    """
    vectors = cut(whole_vectors(rows))
    members = k + 1  # a query's own id may be one of them
    numbered = vectors.withColumn("__n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("__n") <= members)
    nodes = numbered.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    size = vectors.count()
    shards = max(1, math.ceil(size / shard_size))
    parts = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    graphs = stored(parts.groupBy("shard").applyInPandas(lambda frame: _graph_row(frame, degree, build_beam, alpha), GRAPH))
    asked = vectors.where(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")).distinct()
    count = vectors.where(queries).count()
    blocks = max(1, math.ceil(count / query_block))
    # every query meets every shard once: a query is a row of k results for each shard, not of all its vectors
    every_shard, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (shards, blocks))
    block = F.pmod(F.xxhash64("query_id", "asked"), F.lit(blocks)).cast("int").alias("block")
    sent = asked.select("query_id", "asked", block).withColumn("shard", every_shard)
    here = graphs.withColumn("block", every_block)

    def searched(key: tuple, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({name: pd.Series(dtype=object) for name in ("query_id", "score", "ids")})
        return _searched(graphs.iloc[0], queries.sort_values("query_id", ignore_index=True), max(beam, members), members)

    met = here.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
    found = met.applyInPandas(searched, "query_id long, score double, ids array<long>")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _graph_row(nodes: pd.DataFrame, degree: int, build_beam: int, alpha: float) -> pd.DataFrame:
    """The graph of one shard's ``nodes`` (``shard``, ``embedding``, ``ids``), as a row of ``GRAPH``."""
    nodes = nodes.sort_values("ids", key=lambda ids: ids.str[0], ignore_index=True)  # the same graph whatever the rows' order
    own = np.stack(nodes["embedding"].to_numpy())
    lengths = np.einsum("nd,nd->n", own, own)
    filled = np.sqrt(np.maximum(0, lengths.max() - lengths))
    scale = 1 / np.sqrt(lengths.max())  # graphs are kept in single precision
    graph, order = built(np.column_stack((own, filled)) * scale, degree, build_beam, alpha)
    ids = nodes["ids"].to_numpy()[order]
    row = {
        "shard": nodes["shard"][0],
        "length": own.shape[1],
        "own": own[order].tobytes(),
        "vectors": graph.vectors.tobytes(),
        "edges": graph.neighbours.astype(np.int32).tobytes(),
        "entries": graph.entries.astype(np.int32).tobytes(),
        "ids": np.concatenate(ids).astype(np.int64).tobytes(),
        "ends": np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes(),
    }
    return pd.DataFrame([row])


def _searched(row: pd.Series, queries: pd.DataFrame, beam: int, most: int) -> pd.DataFrame:
    """The ``most`` best nodes of the graph in ``row`` for each of ``queries`` (``query_id``, ``asked``), with their ids."""
    own = np.frombuffer(row["own"]).reshape(-1, row["length"])
    size = len(own)
    vectors = np.frombuffer(row["vectors"], dtype=np.float32).reshape(size, -1)
    edges = np.frombuffer(row["edges"], dtype=np.int32).reshape(size, -1).astype(np.int64)
    graph = Graph(vectors, np.einsum("nd,nd->n", vectors, vectors), edges, np.frombuffer(row["entries"], dtype=np.int32).astype(np.int64))
    ends = np.frombuffer(row["ends"], dtype=np.int64)
    held = np.split(np.frombuffer(row["ids"], dtype=np.int64), ends[:-1])
    least = np.array([x[0] for x in held])
    asked, named = np.stack(queries["asked"].to_numpy()), queries["query_id"].to_numpy()
    out = []
    for i in range(0, len(queries), 1024):
        part = asked[i : i + 1024]
        normal = part / np.sqrt(np.einsum("qd,qd->q", part, part))[:, None]
        to, _ = beam_search(graph, np.column_stack((normal, np.zeros(len(part)))).astype(np.float32), beam, expand=4)
        real = to >= 0
        to = np.where(real, to, 0)
        score = np.where(real, np.einsum("qd,qcd->qc", part, own[to]), -np.inf)
        best = np.lexsort((least[to], -score), axis=1)[:, :most]
        q, c = np.nonzero(np.take_along_axis(real, best, axis=1))
        chosen = best[q, c]
        out.append(pd.DataFrame({"query_id": named[i + q], "score": score[q, chosen], "ids": [held[n] for n in to[q, chosen]]}))
    return pd.concat(out, ignore_index=True)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results (``query_id``, ``vec_id``) that were found."""
    keys = ["query_id", "vec_id"]
    row = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left").agg(F.count("hit"), F.count("*")).first()
    return row[0] / row[1] if row[1] else 1.0


def exact_neighbours(rows: DataFrame, queries: Column, k: int = 20, block: int = 512) -> DataFrame:
    """What ``neighbours`` approximates, by brute force in blocks of queries: to measure recall on samples."""
    vectors = cut(whole_vectors(rows))
    asked = vectors.where(queries).distinct()
    held = [(row["vec_id"], row["embedding"]) for row in asked.toLocalIterator()]
    pieces = []
    for i in range(0, len(held), block):
        ids = np.array([x[0] for x in held[i : i + block]])
        own = np.array([x[1] for x in held[i : i + block]])

        def scored(frames: Iterator[pd.DataFrame], ids: np.ndarray = ids, own: np.ndarray = own) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    score = own @ np.stack(frame["embedding"].to_numpy()).T
                    others = frame["vec_id"].to_numpy()
                    score[ids[:, None] == others] = -np.inf
                    best = np.lexsort((np.broadcast_to(others, score.shape), -score), axis=1)[:, :k]
                    q = np.repeat(np.arange(len(ids)), best.shape[1])
                    yield pd.DataFrame({"query_id": ids[q], "vec_id": others[best.ravel()], "score": score[q, best.ravel()]}).query("score > -inf")

        pieces.append(vectors.mapInPandas(scored, "query_id long, vec_id long, score double"))
    if not pieces:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.unionByName(piece)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
