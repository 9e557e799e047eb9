"""Resharding with the fewest bytes moved, by minimum-cost flow.

Rows lie in old shards, each dealt into blocks. The driver sees one size for each block (``old shards * blocks`` at most,
whatever the table's size) and solves a minimum-cost flow from the old shards' sizes to the new shards' capacities: bytes
that stay in the shard of their number cost nothing, a moved byte costs one. Blocks are dealt out by the flow, largest
first, and then single blocks even out what is left, so that the new sizes differ by less than a block can mend. Only
shards that lose or receive a block are written again.

The blocks are hashes of row numbers, so neither a hot source nor copies of one row can fill a block alone. Row numbers are
those of a scan; the input must be a table read from files. A null text has the size of an empty one, 1. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectus.llm.common import cut

BLOCKS = 256


def least_moves(old: list[int], capacity: list[int]) -> np.ndarray:
    """Bytes from each old to each new shard that move the fewest: successive cheapest paths.

    Capacities must hold all bytes.
    """
    k, m = len(old), len(capacity)
    flow = np.zeros((k, m), dtype=object)
    supply, room = list(old), list(capacity)
    cost = [[0 if i == j else 1 for j in range(m)] for i in range(k)]
    while any(supply):
        # cheapest paths from shards with supply, through moves already made (taking one back costs what it had cost less)
        distance: dict[tuple[str, int], int] = {("old", i): 0 for i in range(k) if supply[i]}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        queue = deque(distance)
        while queue:
            side, i = node = queue.popleft()
            if side == "old":
                steps = [(("new", j), cost[i][j]) for j in range(m)]
            else:
                steps = [(("old", h), -cost[h][i]) for h in range(k) if flow[h][i] > 0]
            for to, price in steps:
                if distance[node] + price < distance.get(to, 1 << 60):
                    distance[to], came[to] = distance[node] + price, node
                    queue.append(to)
        end = min((("new", j) for j in range(m) if room[j]), key=lambda node: distance[node])
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(supply[path[0][1]], room[end[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "new"), 1 << 62)
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "old":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        supply[path[0][1]] -= amount
        room[end[1]] -= amount
    return flow


def deal_blocks(sizes: dict[tuple[int, int], int], old_shards: int, shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block)."""
    total = sum(sizes.values())
    old = [0] * old_shards
    for (i, _), size in sizes.items():
        old[i] += size
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    wanted = least_moves(old, capacity)
    held = [0] * shards
    placed: dict[tuple[int, int], int] = {}
    for (i, block), size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        j = max(range(shards), key=lambda j: (wanted[i][j], j == i, -j))
        placed[i, block] = j
        wanted[i][j] -= size
        held[j] += size
    for _ in range(len(sizes)):
        high, low = max(range(shards), key=lambda j: (held[j], -j)), min(range(shards), key=lambda j: (held[j], j))
        gap = held[high] - held[low]
        able = [(size, i != high, (i, block)) for (i, block), size in sizes.items() if placed[i, block] == high and size < gap]
        if not able:
            break
        size, _, key = min(able, key=lambda x: (abs(2 * x[0] - gap), not x[1], x[2]))
        placed[key] = low
        held[high] -= size
        held[low] += size
    return placed


def text_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def placed(docs: DataFrame, shards: int = 16, old_shards: int = 16, old_shard: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with ``old_shard``, ``shard`` and ``__row`` (the row's number in the scan), texts and all.

    ``old_shard`` is where a row lies now, from 0; by default the hash of its source. It may read any column of ``docs``, also
    one that is replaced here.
    """
    now = F.coalesce(old_shard, F.lit(0)) if old_shard is not None else F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % old_shards
    rows = docs.withColumn("__old", now.cast("int")).drop("old_shard", "shard", "__row", "__block").withColumnRenamed("__old", "old_shard")
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("old_shard", "__block").agg(F.sum(text_size(F.col("text"))).alias("size"))
    found = {(row[0], row[1]): row[2] for row in sizes.collect()}  # old_shards * blocks rows at most
    to = deal_blocks(found, old_shards, shards)
    plan = docs.sparkSession.createDataFrame([(i, b, j) for (i, b), j in sorted(to.items())], "old_shard int, __block int, shard int")
    return rows.join(F.broadcast(plan), ["old_shard", "__block"]).drop("__block")


def shard_slots(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``shard`` and ``__row``) with ``slot``: numbers from 0 without gaps in each shard.

    Rows are numbered within their task and shard; sums over the earlier tasks come before. No shard meets in one task.
    """
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row")) - 1
    return rows.withColumn("__own", own).join(before, ["shard", "__part"]).withColumn("slot", (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__before")


def resharded(docs: DataFrame, shards: int = 16, old_shards: int = 16) -> DataFrame:
    """Where every document goes: ``doc_id``, ``size``, ``text_crc32``, ``old_shard``, ``shard``, ``slot``."""
    rows = placed(docs, shards, old_shards)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = cut(rows.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), "old_shard", "shard", "__row"))
    return shard_slots(narrow).drop("__row")


def rewrite_affected(docs: DataFrame, path: str, shards: int = 16, old_shards: int = 16, old_shard: Column | None = None, files: int = 64) -> list[int]:
    """Write anew the shards below ``path`` (folders ``shard=0`` ...) that lose or receive rows; the numbers of these.

    A shard is dealt over up to ``files`` files. Shards that keep all their rows and get none are left as they are. ``docs`` may
    be the very table below ``path``, with ``old_shard`` its column ``shard``: new files replace the old ones when all are
    written. Last, the folders of shards that have lost all their rows are removed.
    """
    rows = placed(docs, shards, old_shards, old_shard)
    changed = rows.where("old_shard <> shard").groupBy("old_shard", "shard").count().collect()  # old_shards * shards rows at most
    moved = sorted({row[name] for row in changed for name in ("old_shard", "shard")})
    left = {row[0] for row in rows.select("shard").distinct().collect()}
    affected = rows.where(F.col("shard").isin(moved) if moved else F.lit(False))
    spread = affected.repartition("shard", F.pmod(F.xxhash64("__row"), F.lit(files)))
    spread.drop("old_shard", "__row").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    folder = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files_of = folder.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for emptied in set(moved) - left:
        files_of.delete(folder.suffix(f"/shard={emptied}"), True)
    return moved
