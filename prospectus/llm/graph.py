"""Robust-pruned directed graphs over the vectors of one shard, and beam search in them.

Nodes are inserted in batches of growing size. A greedy beam search in the graph so far proposes neighbours for each node
of a batch; pruning by relaxed distances keeps a neighbour only if no kept one is nearer to it by the factor ``alpha``, so
that edges point in different directions. Edges back are added and pruned likewise. All steps are whole-array operations
over a batch; memory is bounded by the shard and the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BATCH = 1024
ENTRIES = 32


@dataclass
class Graph:
    """Vectors (by row), their squared lengths, neighbours (rows, -1 for none) and the rows where searches begin."""

    vectors: np.ndarray
    squares: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray


def beam_search(graph: Graph, queries: np.ndarray, beam: int, nodes: int | None = None, expand: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query: rows (-1 for none) and squared distances, nearest first.

    ``nodes``: only so many first rows are in the graph yet. ``expand`` nodes of a beam are opened at a time.
    """
    nodes = len(graph.vectors) if nodes is None else nodes
    size, beam = len(queries), min(beam, nodes)
    lengths = np.einsum("qd,qd->q", queries, queries)
    found = np.full((size, beam), -1, dtype=np.int64)
    distance = np.full((size, beam), np.inf, dtype=np.float32)
    opened = np.ones((size, beam), dtype=bool)
    seen = np.zeros((size, nodes), dtype=bool)
    begin = graph.entries[graph.entries < nodes][:beam]
    found[:, : len(begin)], opened[:, : len(begin)], seen[:, begin] = begin, False, True
    distance[:, : len(begin)] = lengths[:, None] + graph.squares[begin] - 2 * queries @ graph.vectors[begin].T
    active = np.arange(size)
    while len(active):
        waiting = np.where(opened[active], np.inf, distance[active])
        new_found, new_distance = [], []
        for _ in range(expand):
            best = waiting.argmin(axis=1)
            rows = np.arange(len(active))
            usable = np.isfinite(waiting[rows, best])
            waiting[rows, best] = np.inf
            opened[active[usable], best[usable]] = True
            around = np.where(usable[:, None], graph.neighbours[found[active, best]], -1)
            fresh = (around >= 0) & ~seen[active[:, None], around]
            at, slot = np.nonzero(fresh)
            to = around[at, slot]
            seen[active[at], to] = True
            near = np.full(around.shape, np.inf, dtype=np.float32)
            owner = active[at]
            near[at, slot] = lengths[owner] + graph.squares[to] - 2 * np.einsum("ed,ed->e", queries[owner], graph.vectors[to])
            new_found.append(np.where(fresh, around, -1))
            new_distance.append(near)
        all_found = np.concatenate((found[active], *new_found), axis=1)
        all_distance = np.concatenate((distance[active], *new_distance), axis=1)
        all_opened = np.concatenate((opened[active], np.zeros((len(active), all_found.shape[1] - beam), dtype=bool)), axis=1)
        keep = np.argpartition(all_distance, beam - 1, axis=1)[:, :beam]
        rows = np.arange(len(active))[:, None]
        found[active], distance[active] = all_found[rows, keep], all_distance[rows, keep]
        opened[active] = all_opened[rows, keep] | ~np.isfinite(distance[active])
        active = active[~opened[active].all(axis=1)]
    order = np.argsort(distance, axis=1, kind="stable")
    rows = np.arange(size)[:, None]
    return np.where(np.isfinite(distance[rows, order]), found[rows, order], -1), distance[rows, order]


def robust_prune(vectors: np.ndarray, squares: np.ndarray, candidates: np.ndarray, distance: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (nearest first, infinite where none) at most ``degree`` diverse ones, -1 beyond."""
    own = vectors[candidates]
    among = squares[candidates][:, :, None] + squares[candidates][:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    alive = np.isfinite(distance) & (candidates >= 0)
    kept = np.full((len(candidates), degree), -1, dtype=np.int64)
    rows = np.arange(len(candidates))
    for slot in range(degree):
        first = alive.argmax(axis=1)
        usable = alive[rows, first]
        if not usable.any():
            break
        kept[usable, slot] = candidates[rows, first][usable]
        alive &= alpha * alpha * among[rows, first] > distance
        alive[rows, first] = False
    return kept


def built(vectors: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 3) -> tuple[Graph, np.ndarray]:
    """A graph over ``vectors`` and the order of its rows: row i of the graph is row ``order[i]`` of ``vectors``.

    Searches begin at the medoid, which is inserted first, and at ``ENTRIES`` random rows: where near copies crowd around
    the medoid, edges that lead away from it can all be pruned.
    """
    size = len(vectors)
    order = np.random.default_rng(seed).permutation(size)
    centre = vectors.mean(axis=0)
    medoid = int(((vectors - centre) ** 2).sum(axis=1).argmin())
    at = int(np.flatnonzero(order == medoid)[0])
    order[[0, at]] = order[[at, 0]]
    own = np.ascontiguousarray(vectors[order], dtype=np.float32)
    graph = Graph(own, np.einsum("nd,nd->n", own, own), np.full((size, degree), -1, dtype=np.int64), np.arange(min(size, 1 + ENTRIES)))
    done = min(size, 2 * degree)
    _connect(graph, np.arange(done), *_all_near(graph, done), degree, alpha)
    while done < size:
        batch = np.arange(done, min(size, done + min(BATCH, done)))
        found, distance = beam_search(graph, own[batch], beam, nodes=done)
        within = min(len(batch), beam)  # nodes of one batch may be each other's nearest
        _, near_found, near_distance = _near(graph, batch, batch, within)
        _connect(graph, batch, *_merged(found, distance, near_found, near_distance), degree, alpha)
        done += len(batch)
    return graph, order


def _near(graph: Graph, rows: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    apart = graph.squares[rows][:, None] + graph.squares[others] - 2 * graph.vectors[rows] @ graph.vectors[others].T
    apart[rows[:, None] == others] = np.inf
    take = np.argsort(apart, axis=1, kind="stable")[:, :most]
    return rows, others[take], np.take_along_axis(apart, take, axis=1)


def _all_near(graph: Graph, done: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(done)
    return _near(graph, rows, rows, done)[1:]


def _merged(found: np.ndarray, distance: np.ndarray, more: np.ndarray, more_distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every, apart = np.concatenate((found, more), axis=1), np.concatenate((distance, more_distance), axis=1)
    take = np.argsort(apart, axis=1, kind="stable")[:, : found.shape[1] + more.shape[1] // 2]
    return np.take_along_axis(every, take, axis=1), np.take_along_axis(apart, take, axis=1)


def _connect(graph: Graph, rows: np.ndarray, candidates: np.ndarray, distance: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from ``rows`` to diverse candidates, and back."""
    for i in range(0, len(rows), 256):
        part = slice(i, i + 256)
        graph.neighbours[rows[part]] = robust_prune(graph.vectors, graph.squares, candidates[part], distance[part], degree, alpha)
    source, slot = np.nonzero(graph.neighbours[rows] >= 0)
    target, source = graph.neighbours[rows][source, slot], rows[source]
    present = (graph.neighbours[target] == source[:, None]).any(axis=1)
    target, source = target[~present], source[~present]
    while len(target):  # each target takes up to ``degree`` of its new edges at a time
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        first = np.searchsorted(target, target)
        place = np.arange(len(target)) - first
        now = place < degree
        nodes, index = np.unique(target[now], return_inverse=True)
        added = np.full((len(nodes), degree), -1, dtype=np.int64)
        added[index, place[now]] = source[now]
        for i in range(0, len(nodes), 512):
            own, new = nodes[i : i + 512], added[i : i + 512]
            every = np.concatenate((graph.neighbours[own], new), axis=1)
            apart = graph.squares[own][:, None] + graph.squares[every] - 2 * np.einsum("nd,ncd->nc", graph.vectors[own], graph.vectors[every])
            apart[every < 0] = np.inf
            take = np.argsort(apart, axis=1, kind="stable")
            every, apart = np.take_along_axis(every, take, axis=1), np.take_along_axis(apart, take, axis=1)
            crowded = (every >= 0).sum(axis=1) > degree
            merged = np.where(np.isfinite(apart), every, -1)[:, :degree]
            if crowded.any():
                merged[crowded] = robust_prune(graph.vectors, graph.squares, every[crowded], apart[crowded], degree, alpha)
            graph.neighbours[own] = merged
        target, source = target[~now], source[~now]
