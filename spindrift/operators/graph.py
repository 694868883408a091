"""Proximity graphs within segments: build, search, deletion, statistics.

A segment is a bounded part of the base that one task holds; its graph is built
and searched there in numpy, and Spark spreads the segments.  Results of all
segments meet in a ranking, so that the answer gets better, not worse, with more
segments.  Everything random comes from hashes of ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.options import BuildOptions
from ..session import importable
from . import search


#: Rows of a segment, as far as it is cut by size; random candidates of each node; fruitless steps after which a threshold search ends.
SEGMENT_ROWS, FAR, PATIENCE = 8192, 8, 64


def similarity(metric: str, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return search.block_scores(metric, q[None], rows)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = np.asarray(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw_levels(ids: np.ndarray, options: BuildOptions) -> np.ndarray:
    """Top layer of each node: geometric, from a hash of its id."""
    if not options.hierarchy:
        return np.zeros(len(ids), dtype=np.int64)
    u = (mixed(ids).astype(np.float64) + 1) / (2.0**64 + 1)
    scale = 1.0 if options.degree == 1 else 1 / np.log(options.degree)
    return np.minimum(31, -np.log(u) * scale).astype(np.int64)


def distances(metric: str, scores: np.ndarray) -> np.ndarray:
    """Squared distance, or one less the product, that a score stands for; unknown ones are the farthest."""
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 1 / scores - 1 if metric == "l2" else 2 * (1 - scores)
    return np.where(np.isnan(d), np.inf, d)


def pruned(own: np.ndarray, between: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of many nodes at once: places of the chosen candidates of each, nearest first, and -1 for none.

    own: distances of each node to its candidates, infinite where there is none;
    between: those among the candidates.  The nearest candidate left is chosen, and
    it covers all that are ``alpha`` times as far from the node as from it.  A first
    pass with 1 for alpha puts direction before number.
    """
    n, width = own.shape
    chosen, count = np.full((n, degree), -1), np.zeros(n, dtype=np.int64)
    at, taken = np.arange(n), ~np.isfinite(own)
    own = own - np.minimum(0, np.where(taken, 0, own).min(axis=1, initial=0))[:, None]  # products of long vectors can be negative
    for slack in sorted({1.0, alpha}):
        covered = taken.copy()
        for place in range(degree):
            rows = at[place < count]
            covered[rows] |= slack * between[rows, chosen[rows, place]] <= own[rows]
        while width:
            left = np.where(covered, np.inf, own)
            pick = left.argmin(axis=1)
            rows = at[np.isfinite(left[at, pick]) & (count < degree)]
            if not len(rows):
                break
            p = pick[rows]
            chosen[rows, count[rows]] = p
            count[rows] += 1
            taken[rows, p] = covered[rows, p] = True
            covered[rows] |= slack * between[rows, p] <= own[rows]
    return chosen


@dataclass
class Found:
    """Results of a graph search: (score, node), best first, and what it cost.

    worst_approximate: the least approximate score among the results, infinite if
    there are fewer than asked for.
    """

    results: list[tuple[float, int]]
    visited: int = 0
    expanded: int = 0
    expanded_base: int = 0
    reranked: int = 0
    worst_approximate: float = float("inf")
    walk: Walk | None = None


class Walk:
    """A best-first walk through one layer, which can be taken up again for more results.

    A filter decides what is a result, not where the walk may go.
    """

    def __init__(self, adjacent: dict[int, list[int]], score, start: list[tuple[float, int]], accept=None, threshold: float | None = None) -> None:
        self.adjacent, self.score, self.accept, self.threshold = adjacent, score, accept, threshold
        self.seen = {n for _, n in start}
        self.open = [(-s, n) for s, n in start]
        heapq.heapify(self.open)
        self.spare: list[tuple[float, int]] = []  # results that found no room yet, best first
        self.visited, self.expanded = len(start), 0
        for s, n in start:
            self._offer(s, n)

    def _offer(self, s: float, n: int) -> None:
        if (self.accept is None or self.accept(n)) and (self.threshold is None or s >= self.threshold):
            heapq.heappush(self.spare, (-s, n))

    def next(self, width: int) -> list[tuple[float, int]]:
        """The ``width`` best results that were not given yet."""
        best: list[tuple[float, int]] = []  # the least of them first

        def fill() -> None:
            while self.spare and (len(best) < width or -self.spare[0][0] > best[0][0]):
                s, n = heapq.heappop(self.spare)
                heapq.heappush(best, (-s, -n))
                if len(best) > width:
                    s, n = heapq.heappop(best)
                    heapq.heappush(self.spare, (-s, -n))

        fill()
        top, fruitless = -np.inf, 0
        while self.open:
            s, node = self.open[0]
            if len(best) >= width and -s < best[0][0]:
                break
            if self.threshold is not None and fruitless >= PATIENCE and -s < self.threshold:
                break  # the frontier is below the threshold and has not come nearer for long
            heapq.heappop(self.open)
            self.expanded += 1
            fruitless += 1
            fresh = [n for n in self.adjacent.get(node, ()) if n not in self.seen]
            if not fresh:
                continue
            self.seen.update(fresh)
            self.visited += len(fresh)
            for n, score in zip(fresh, self.score(fresh).tolist()):
                if score > top or (self.threshold is not None and score >= self.threshold):
                    top, fruitless = max(top, score), 0
                heapq.heappush(self.open, (-score, n))
                self._offer(score, n)
            fill()
        return sorted(((s, -n) for s, n in best), key=lambda x: (-x[0], x[1]))

    def last(self, width: int) -> list[tuple[float, int]]:
        """What ``next`` gives, by the same steps, after which the walk cannot be taken up again.

        Nodes below the ``width`` best so far lead nowhere and are no result, so they are
        not kept.  Scores come as a list; there is no threshold.
        """
        best = [(-s, -n) for s, n in (heapq.heappop(self.spare) for _ in range(min(width, len(self.spare))))]
        heapq.heapify(best)
        adjacent, seen, open_, accept, least = self.adjacent, self.seen, self.open, self.accept, best[0][0] if len(best) >= width else -np.inf
        while open_ and -open_[0][0] >= least:
            node = heapq.heappop(open_)[1]
            self.expanded += 1
            fresh = [n for n in adjacent.get(node, ()) if n not in seen]
            seen.update(fresh)
            self.visited += len(fresh)
            kept = sorted((-s, n) for s, n in zip(self.score(fresh), fresh) if s >= least) if fresh else ()
            for s, n in kept:
                heapq.heappush(open_, (s, n))
                if accept is not None and not accept(n):
                    continue
                if len(best) < width:
                    heapq.heappush(best, (-s, -n))
                elif -s > best[0][0]:
                    heapq.heapreplace(best, (-s, -n))
            if len(best) >= width:
                least = best[0][0]
        return sorted(((s, -n) for s, n in best), key=lambda x: (-x[0], x[1]))


@dataclass
class Graph:
    """Layers of neighbour lists over the rows of ``vectors``, in order of ``ids``; rows are nodes."""

    vectors: np.ndarray
    ids: np.ndarray
    metric: str
    options: BuildOptions
    layers: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    entry: int | None = None
    deleted: set[int] = field(default_factory=set)
    codes: np.ndarray | None = None
    _places: np.ndarray | None = field(default=None, init=False, repr=False)
    _code_length2: np.ndarray | None = field(default=None, init=False, repr=False)

    def scores(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        s = similarity(self.metric, q, self.vectors[nodes])
        return np.where(np.isnan(s), -np.inf, s)

    def provider(self, q: np.ndarray, codec=None):
        """Scores of nodes for a query: exact, or approximate by the codes of the nodes."""
        if codec is None:
            return lambda nodes: self.scores(q, nodes)
        table = codec.tables(q[None], "l2" if self.metric == "l2" else "dot")[0]
        if self._places is None:  # once for all queries: where each node's codes are in a table, and the squared length they stand for
            self._places = np.ascontiguousarray((self.codes.astype(np.int64) + codec.k * np.arange(codec.m)).T)
            self._code_length2 = codec.magnitudes()[self._places].sum(axis=0)
        places, own2 = self._places, float(codec._sum(q[None], q[None])[0])

        def approximate(nodes: list[int]) -> np.ndarray:
            total = table[places[:, nodes]].sum(axis=0)
            if self.metric == "l2":
                return 1 / (1 + total)
            if self.metric == "dot":
                return (1 + total) / 2
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (1 + total / np.sqrt(self._code_length2[nodes] * own2)) / 2
            return np.where(np.isnan(s), -np.inf, s)

        return approximate

    def code_scores(self, q: np.ndarray, codec) -> np.ndarray:
        """Approximate scores of all nodes, a row for each query, as ``provider`` gives them."""
        self.provider(q[0], codec)
        tables, total, found = np.ascontiguousarray(codec.tables(q, "l2" if self.metric == "l2" else "dot").T), np.zeros((len(self.ids), len(q))), np.empty((len(self.ids), len(q)))
        for place in self._places:
            total += np.take(tables, place, axis=0, out=found)
        if self.metric == "l2":
            return (1 / (1 + total)).T
        if self.metric == "dot":
            return ((1 + total) / 2).T
        with np.errstate(invalid="ignore", divide="ignore"):
            s = (1 + total / np.sqrt(self._code_length2[:, None] * codec._sum(q, q)[None])) / 2
        return np.where(np.isnan(s), -np.inf, s).T

    # searching

    def search_all(self, q: np.ndarray, k: int, rerank_k: int | None = None, accept=None, floor: float | None = None, codec=None) -> Iterator[Found]:
        """What ``search`` finds for each query, by the same steps, with no walk to take up again; ``accept`` is one condition for each query, or None.

        Approximate scores of some queries with all nodes are looked up at once.
        """
        q = np.asarray(q, dtype=np.float64)
        step = max(1, search.SCORES // max(1, len(self.ids)))
        for start in range(0, len(q), step):
            part = q[start : start + step]
            rows = self.code_scores(part, codec) if codec is not None and self.entry is not None else None
            for n, x in enumerate(part):
                if rows is None:
                    score = lambda nodes, x=x: self.scores(x, nodes).tolist()
                else:
                    score = lambda nodes, row=rows[n].tolist(): [row[i] for i in nodes]
                yield self.search(x, k, rerank_k, None, accept[start + n] if accept is not None else None, floor, codec, score)

    def search(self, q: np.ndarray, k: int, rerank_k: int | None = None, threshold: float | None = None, accept=None, floor: float | None = None, codec=None, last=None) -> Found:
        """The k best nodes; ``rerank_k`` widens the search.

        With a codec the walk goes by approximate scores, and the ``rerank_k`` best
        get exact ones: all that reach ``floor``, or the first if none does.  The
        threshold holds for the scores that the walk goes by.  last: lists of these scores,
        for a search without threshold that is not taken up again.
        """
        width = k if rerank_k is None else rerank_k
        if width < k:
            raise ValueError(f"rerank_k {width} must be at least k {k}")
        if self.entry is None:
            return Found([])
        q = np.asarray(q, dtype=np.float64)
        score = last or self.provider(q, codec)
        start = [(float(score([self.entry])[0]), self.entry)]
        visited = expanded = 0
        for level in range(len(self.layers) - 1, 0, -1):  # down the hierarchy, unfiltered
            walk = Walk(self.layers[level], score, start)
            start = (walk.last(1) if last else walk.next(1)) or start
            visited, expanded = visited + walk.visited, expanded + walk.expanded
        live = (lambda n: n not in self.deleted and (accept is None or accept(n))) if self.deleted or accept else None
        walk = Walk(self.layers[0], score, start, live, threshold)
        found = walk.last(width) if last else walk.next(width)
        out = self._found(q, found, k, floor, codec, walk, visited, expanded)
        if last:
            out.walk = None
        return out

    def resume(self, q: np.ndarray, before: Found, k: int, rerank_k: int | None = None, floor: float | None = None, codec=None) -> Found:
        """The next k after an earlier search, whose walk goes on from where it stood."""
        return self._found(np.asarray(q, dtype=np.float64), before.walk.next(k if rerank_k is None else rerank_k), k, floor, codec, before.walk, 0, 0)

    def _found(self, q: np.ndarray, found: list[tuple[float, int]], k: int, floor: float | None, codec, walk: Walk, visited: int, expanded: int) -> Found:
        reranked, worst = 0, float("inf")
        if codec is not None:
            chosen = [x for x in found if floor is None or x[0] >= floor] or found[:1]
            exact = self.scores(q, [n for _, n in chosen]).tolist() if chosen else []
            both = sorted(((e, n, s) for e, (s, n) in zip(exact, chosen)), key=lambda x: (-x[0], x[1]))[:k]
            reranked, worst = len(chosen), min((s for *_, s in both), default=worst) if len(both) == k else worst
            # what has no room now comes with the next page
            given = {n for _, n, _ in both}
            for s, n in found:
                if n not in given:
                    heapq.heappush(walk.spare, (-s, n))
            results = [(e, n) for e, n, _ in both]
        else:
            results = found[:k]
            for s, n in found[k:]:
                heapq.heappush(walk.spare, (-s, n))
        return Found(results, visited + walk.visited, expanded + walk.expanded, walk.expanded, reranked, worst, walk)

    # building

    def diverse(self, q: np.ndarray, candidates: list[tuple[float, int]], degree: int) -> list[int]:
        """Of the candidates (best first), those that pruning leaves of a node at q."""
        if not candidates:
            return []
        nodes = [n for _, n in candidates]
        own = distances(self.metric, np.array([s for s, _ in candidates]))
        between = distances(self.metric, search.block_scores(self.metric, self.vectors[nodes], self.vectors[nodes]))
        chosen = pruned(own[None], between[None], degree, self.options.alpha)[0]
        return [nodes[i] for i in chosen[chosen >= 0]]

    def _choose(self, nodes: np.ndarray, pools: list[np.ndarray], degree: int) -> list[list[int]]:
        """Neighbours of each node out of its pool of other nodes; pools of like size are pruned together."""
        out: list[list[int]] = [[] for _ in nodes]
        sizes = np.array([len(p) for p in pools])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            step = max(1, search.SCORES // max(1, int(sizes[order[min(len(order) - 1, at + 255)]]) ** 2))
            part = order[at : at + min(256, step)]
            at += len(part)
            width = int(sizes[part].max())
            pool = np.zeros((len(part), width), dtype=np.int64)
            there = np.arange(width)[None] < sizes[part][:, None]
            pool[there] = np.concatenate([pools[i] for i in part])
            own = np.where(there, distances(self.metric, self._pair_scores(nodes[part][:, None], pool)[:, 0]), np.inf)
            near = np.lexsort((self.ids[pool], own))  # nearest first, so that ties go by id
            pool, own = np.take_along_axis(pool, near, 1), np.take_along_axis(own, near, 1)
            chosen = pruned(own, distances(self.metric, self._pair_scores(pool, pool)), degree, self.options.alpha)
            for row, i in enumerate(part):
                out[i] = pool[row, chosen[row][chosen[row] >= 0]].tolist()
        return out

    def _pair_scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Scores of each node of a row of ``left`` with each of the same row of ``right``."""
        a, b = self.vectors[left], self.vectors[right]
        product = a @ b.transpose(0, 2, 1)
        if self.metric == "dot":
            return (1 + product) / 2
        a2, b2 = (a * a).sum(axis=2)[:, :, None], (b * b).sum(axis=2)[:, None]
        if self.metric == "l2":
            return 1 / (1 + np.maximum(0, a2 + b2 - 2 * product))
        with np.errstate(invalid="ignore", divide="ignore"):
            return (1 + product / np.sqrt(a2 * b2)) / 2

    def _nearest(self, nodes: np.ndarray, among: np.ndarray, k: int) -> list[np.ndarray]:
        """The k nearest others of each node, by blocks of products."""
        out = []
        step = max(1, search.SCORES // max(1, len(among)))
        for start in range(0, len(nodes), step):
            rows = nodes[start : start + step]
            s = search.block_scores(self.metric, self.vectors[rows], self.vectors[among])
            s = np.where(np.isnan(s), -np.inf, s)
            s[rows[:, None] == among[None]] = -np.inf
            wide = min(k, len(among))
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            out += [among[t[np.isfinite(v)]] for t, v in zip(top, np.take_along_axis(s, top, 1))]
        return out

    def _layer_lists(self, level: int, nodes: np.ndarray, pools: list[np.ndarray]) -> None:
        """Neighbour lists of a layer: each node's own choice, then with those who chose it."""
        degree = self.options.layer_degree(level)
        lists = self._choose(nodes, pools, degree)
        both = {int(n): set(near) for n, near in zip(nodes, lists)}
        for n, near in zip(nodes.tolist(), lists):
            for other in near:
                both[other].add(n)
        full = [n for n in nodes.tolist() if len(both[n]) > degree]
        adjacent = {n: sorted(near, key=lambda x: self.ids[x]) for n, near in both.items()}
        # of very many only the nearest count, as a list takes the nearest first
        wide = 8 * self.options.beam
        cut = [np.array(adjacent[n]) if len(adjacent[n]) <= wide else self._nearest(np.array([n]), np.array(adjacent[n]), wide)[0] for n in full]
        adjacent |= dict(zip(full, self._choose(np.array(full, dtype=np.int64), cut, degree)))
        self.layers[level] = adjacent
        self._connect(level)

    def reached(self, level: int) -> set[int]:
        """Nodes of a layer that a walk can come to from the entry, or from the least node if that is not in it."""
        adjacent = self.layers[level]
        if not adjacent:
            return set()
        first = self.entry if self.entry in adjacent else min(adjacent, key=lambda n: self.ids[n])
        seen, open_ = {first}, [first]
        while open_:
            fresh = {n for node in open_ for n in adjacent[node]} - seen
            seen |= fresh
            open_ = list(fresh)
        return seen

    def _connect(self, level: int) -> None:
        """Let the nearest reached node with room point to each part that a walk cannot come to."""
        adjacent, degree = self.layers[level], self.options.layer_degree(level)
        seen = self.reached(level)
        for node in sorted(adjacent.keys() - seen, key=lambda n: self.ids[n]):
            if node in seen:
                continue
            there = np.array(sorted(seen))
            room = np.array([n for n in there if len(adjacent[n]) < degree])
            if len(room):
                near = int(room[np.argmax(self.scores(self.vectors[node], room))])
                adjacent[near].append(node)
            else:
                near = int(there[np.argmax(self.scores(self.vectors[node], there))])
                adjacent[near][-1] = node
            seen, open_ = seen | {node}, [node]
            while open_:
                fresh = {n for o in open_ for n in adjacent[o]} - seen
                seen |= fresh
                open_ = list(fresh)

    def _far(self, nodes: np.ndarray, among: np.ndarray) -> np.ndarray:
        """A few other nodes for each, by a hash of its id."""
        return among[(mixed(self.ids[nodes][:, None] * FAR + np.arange(FAR)) % np.uint64(len(among))).astype(np.int64)]

    def _start(self) -> None:
        """Empty layers and the entry: the node of the highest level, the least of these."""
        tops = draw_levels(self.ids, self.options)
        self.layers = [{} for _ in range(int(tops.max()) + 1 if len(tops) else 1)]
        self.entry = int(np.lexsort((self.ids, -tops))[0]) if len(tops) else None
        self._tops = tops

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, metric: str, options: BuildOptions) -> Graph:
        """A graph in one batch: candidates of a node are its ``beam`` nearest and a few far ones."""
        order = np.argsort(ids, kind="stable")
        graph = cls(np.asarray(vectors, dtype=np.float64)[order], np.asarray(ids)[order], metric, options)
        graph._start()
        for level in range(len(graph.layers)):
            nodes = np.flatnonzero(graph._tops >= level)
            near, far = graph._nearest(nodes, nodes, options.beam), graph._far(nodes, nodes)
            graph._layer_lists(level, nodes, [(u := np.unique(np.concatenate([a, b])))[u != n] for n, a, b in zip(nodes, near, far)])
        return graph

    @classmethod
    def merge(cls, parts: list[Graph], options: BuildOptions) -> Graph:
        """One graph of the live nodes of several, whose ids differ.

        Candidates of a node are its neighbours in its own graph, what deleted ones
        among these pointed to, its nearest nodes in every other graph, and a few
        far ones.  No node is searched for in its own graph again.
        """
        live = [np.array([n not in p.deleted for n in range(len(p.ids))], dtype=bool) for p in parts]
        ids = np.concatenate([p.ids[k] for p, k in zip(parts, live)])
        if len(np.unique(ids)) != len(ids):
            raise ValueError("an id stands in several graphs")
        order = np.argsort(ids, kind="stable")
        graph = cls(np.concatenate([p.vectors[k] for p, k in zip(parts, live)])[order], ids[order], parts[0].metric, options)
        graph._start()
        source = np.repeat(np.arange(len(parts)), [int(k.sum()) for k in live])[order]
        place = [dict(zip(np.flatnonzero(k).tolist(), np.searchsorted(graph.ids, p.ids[k]).tolist())) for p, k in zip(parts, live)]
        known: dict[int, np.ndarray] = {}
        for p, to in zip(parts, place):
            for node, near in p.layers[0].items():
                if node in to:
                    pool = set(near) | {n for x in near if x in p.deleted for n in p.layers[0].get(x, ())}
                    known[to[node]] = np.array([to[n] for n in pool if n in to], dtype=np.int32)
        for level in range(len(graph.layers)):
            nodes = np.flatnonzero(graph._tops >= level)
            # arrays, as sets of so many numbers would be most of what a task holds
            pools: dict[int, list[np.ndarray]] = {int(n): [known[int(n)]] if level == 0 and int(n) in known else [] for n in nodes}
            for i in range(len(parts)):
                of = nodes[source[nodes] == i]
                ask = nodes[source[nodes] != i] if level == 0 else nodes
                if len(of) and len(ask):
                    for n, near in zip(ask.tolist(), graph._nearest(ask, of, options.beam)):
                        pools[n].append(near.astype(np.int32))
            for n, far in zip(nodes.tolist(), graph._far(nodes, nodes)):
                pools[n].append(far.astype(np.int32))
            graph._layer_lists(level, nodes, [(u := np.unique(np.concatenate(pools.pop(n))))[u != n] for n in nodes.tolist()])
        return graph

    def _link(self, level: int, node: int, candidates: list[tuple[float, int]]) -> None:
        """Give a node its neighbours, and let them point back, within the overflow."""
        degree = self.options.layer_degree(level)
        adjacent = self.layers[level]
        adjacent[node] = self.diverse(self.vectors[node], candidates, degree)
        for other in adjacent[node]:
            back = adjacent.setdefault(other, [])
            if node not in back:
                back.append(node)
                if len(back) > self.options.overflow * degree:
                    self._prune(level, other, degree)

    def _prune(self, level: int, node: int, degree: int) -> None:
        near = self.layers[level][node]
        s = self.scores(self.vectors[node], near)
        order = sorted(range(len(near)), key=lambda i: (-s[i], self.ids[near[i]]))
        self.layers[level][node] = self.diverse(self.vectors[node], [(float(s[i]), near[i]) for i in order], degree)

    def add(self, id_: int, vector: np.ndarray) -> int:
        """Insert one more vector, by a search for its neighbours; ids must come in ascending order."""
        if len(self.ids) and id_ <= self.ids[-1]:
            raise ValueError("ids must come in ascending order")
        node, vector = len(self.ids), np.asarray(vector, dtype=np.float64)
        self.vectors, self.ids = np.concatenate([self.vectors, vector[None]]) if node else vector[None], np.append(self.ids, id_)
        top = int(draw_levels(np.array([id_]), self.options)[0])
        entry_top = -1 if self.entry is None else max(level for level, a in enumerate(self.layers) if self.entry in a)
        while len(self.layers) <= top:
            self.layers.append({})
        score = self.provider(vector)
        start = [] if self.entry is None else [(float(score([self.entry])[0]), self.entry)]
        for level in range(entry_top, -1, -1):
            start = Walk(self.layers[level], score, start).next(self.options.beam if level <= top else 1) or start
            if level <= top:
                self._link(level, node, start)
        for level in range(entry_top + 1, top + 1):
            self.layers[level][node] = []
        if top > entry_top:
            self.entry = node
        return node

    def finish(self) -> Graph:
        """Search every node again if asked to, and bring all lists down to their degree."""
        if self.options.refine:
            for level in range(min(2, len(self.layers)) - 1, -1, -1):
                for node in list(self.layers[level]):
                    near = self.layers[level][node]
                    if near:
                        score = self.provider(self.vectors[node])
                        found = Walk(self.layers[level], score, [(float(score(near[:1])[0]), near[0])]).next(self.options.beam)
                        merged = {n: s for s, n in found if n != node} | dict(zip(near, score(near).tolist()))
                        self._link(level, node, sorted(((s, n) for n, s in merged.items()), key=lambda x: (-x[0], self.ids[x[1]])))
        for level, adjacent in enumerate(self.layers):
            for node in list(adjacent):
                if len(adjacent[node]) > self.options.layer_degree(level):
                    self._prune(level, node, self.options.layer_degree(level))
        return self

    def check(self) -> Graph:
        """An error if the entry is not where a search can start, or a list names what is not there."""
        nodes = self.layers[0].keys()
        if (self.entry is None) != (not nodes) or (nodes and self.entry not in self.layers[-1]):
            raise ValueError("the entry is not a node of the highest layer")
        for level, adjacent in enumerate(self.layers):
            below = self.layers[level - 1].keys() if level else adjacent.keys()
            if not adjacent.keys() <= below or any(n == node or n not in adjacent for node, near in adjacent.items() for n in near):
                raise ValueError(f"layer {level} points to what is not in it")
        return self

    # deleting

    def delete(self, nodes: set[int]) -> None:
        """Hide nodes from results; they still lead the search."""
        self.deleted |= nodes

    def remove_deleted(self) -> Graph:
        """Take deleted nodes out: who pointed to one now also considers what it pointed to."""
        for level, adjacent in enumerate(self.layers):
            gone = self.deleted & adjacent.keys()
            for node in [n for n in adjacent if n not in gone]:
                near = adjacent[node]
                if not gone.intersection(near):
                    continue
                pool = {n for n in near if n not in gone}
                for g in gone.intersection(near):
                    pool.update(n for n in adjacent[g] if n not in gone and n != node)
                if not pool:
                    rest = [n for n in adjacent if n not in gone and n != node]
                    pool.update(rest[:: max(1, len(rest) // self.options.layer_degree(level))][: self.options.layer_degree(level)])
                nodes = list(pool)
                s = self.scores(self.vectors[node], nodes) if nodes else []
                order = sorted(range(len(nodes)), key=lambda i: (-s[i], self.ids[nodes[i]]))
                adjacent[node] = self.diverse(self.vectors[node], [(float(s[i]), nodes[i]) for i in order], self.options.layer_degree(level))
            for g in gone:
                del adjacent[g]
        while len(self.layers) > 1 and not self.layers[-1]:
            self.layers.pop()
        top = self.layers[-1]
        if self.entry not in top:
            self.entry = min(top, key=lambda n: self.ids[n]) if top else None
        self.deleted = set()
        return self

    def rescore(self, vectors: np.ndarray, metric: str | None = None) -> Graph:
        """The same topology over other vectors."""
        out = Graph(np.asarray(vectors, dtype=np.float64), self.ids, metric or self.metric, self.options, [dict(a) for a in self.layers], self.entry, set(self.deleted))
        return out

    # as rows

    def rows(self, segment: int) -> pd.DataFrame:
        out = []
        for level, adjacent in enumerate(self.layers):
            for node, near in adjacent.items():
                s = self.scores(self.vectors[node], near).tolist() if near else []
                out.append((segment, level, int(self.ids[node]), [int(self.ids[n]) for n in near], s, node == self.entry and level == len(self.layers) - 1))
        return pd.DataFrame(out, columns=["segment", "level", "node", "neighbors", "scores", "entry"])

    @classmethod
    def from_rows(cls, rows: pd.DataFrame, ids: np.ndarray, vectors: np.ndarray, metric: str, options: BuildOptions, parts: int = 0) -> Graph:
        """A graph from its rows; with ``parts`` codes of so many numbers come from those beside the neighbours."""
        order = np.argsort(ids, kind="stable")
        graph = cls(np.asarray(vectors, dtype=np.float64)[order], np.asarray(ids)[order], metric, options)
        place = {int(v): i for i, v in enumerate(graph.ids)}
        graph.layers = [{} for _ in range(int(rows.level.max()) + 1 if len(rows) else 1)]
        if parts:
            graph.codes = np.zeros((len(graph.ids), parts), dtype=np.int64)
        for r in rows.itertuples():
            graph.layers[r.level][place[r.node]] = [place[n] for n in r.neighbors if n in place]
            if r.entry:
                graph.entry = place[r.node]
            if parts:
                graph.codes[place[r.node]] = r.codes
                for n, c in zip(r.neighbors, r.neighbor_codes):
                    graph.codes[place[n]] = c
        return graph


GRAPH = "segment int, level int, node long, neighbors array<long>, scores array<double>, entry boolean"


def segments_for(rows: int, most: int = SEGMENT_ROWS) -> int:
    """Segments of about ``most`` rows, which a task can hold."""
    return max(1, -(-rows // most))


def with_segment(vectors: DataFrame, n: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """A segment number from a hash of the id; without n by the number of rows."""
    return vectors.withColumn("segment", F.pmod(F.xxhash64(id_col), F.lit(n or segments_for(vectors.count()))).cast("int"))


def build(vectors: DataFrame, metric: str = "cosine", options: BuildOptions = BuildOptions()) -> DataFrame:
    """Graphs of all segments; vectors has segment, vec_id and embedding."""
    importable(vectors.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return Graph.build(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()), metric, options).rows(int(pdf["segment"].iloc[0]))

    return vectors.select("segment", "vec_id", "embedding").groupBy("segment").applyInPandas(one, GRAPH)


def compact(graph: DataFrame, vectors: DataFrame, targets: int, deleted: DataFrame | None = None, metric: str = "cosine", options: BuildOptions = BuildOptions()) -> DataFrame:
    """Graphs of ``targets`` segments out of those of more, without the deleted ids; segment s goes to s modulo targets.

    The base belongs to the result with its segment taken likewise.
    """
    importable(graph.sparkSession)
    to = F.pmod(F.col("segment"), F.lit(targets)).cast("int")
    rows = vectors.select("segment", "vec_id", "embedding").withColumn("target", to)
    rows = rows.join(deleted.select("vec_id", F.lit(True).alias("gone")).distinct(), "vec_id", "left") if deleted is not None else rows.withColumn("gone", F.lit(None).cast("boolean"))

    def one(key, edges: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for segment, own in edges.groupby("segment"):
            base = pdf[pdf["segment"] == segment]
            g = Graph.from_rows(own, base["vec_id"].to_numpy(), np.stack(base["embedding"].to_numpy()), metric, options)
            gone = set(base.loc[base["gone"].notna(), "vec_id"])
            g.delete({i for i, v in enumerate(g.ids) if v in gone})
            parts.append(g)
        if not any(len(p.ids) > len(p.deleted) for p in parts):
            return pd.DataFrame(columns=[c.split()[0] for c in GRAPH.split(", ")])
        return Graph.merge(parts, options).check().rows(int(key[0]))

    return graph.drop("scores").withColumn("target", to).groupBy("target").cogroup(rows.groupBy("target")).applyInPandas(one, GRAPH)


RESULT = "query_id long, vec_id long, score double, visited long, expanded long, expanded_base long, reranked long, worst_approximate double"


def completed(g: Graph, ids: np.ndarray, q: np.ndarray, found: list[Found], k: int, good: np.ndarray, exclude_self: bool) -> list[list[tuple[float, int]]]:
    """The k best nodes of each query by exact scores, ties by id: walks say how good these are at least, and products find all that are."""
    least = np.array([r.results[-1][0] if len(r.results) == k else -np.inf for r in found])
    least -= search.MARGIN * np.maximum(1, np.where(np.isfinite(least), np.abs(least), 1))
    best = search.Best(len(ids), k)
    step = max(16, search.SCORES // len(ids))
    for start in range(0, len(g.ids), step):
        own, vectors = g.ids[start : start + step], g.vectors[start : start + step]
        s = search.block_scores(g.metric, q, vectors)
        s[:, ~good[start : start + step]] = np.nan
        at_q, at_b = search.chosen(s, k, None, search.MARGIN, np.maximum(best.least, least))
        if exclude_self:
            other = ids[at_q] != own[at_b]
            at_q, at_b = at_q[other], at_b[other]
        values = search.exact_scores(g.metric, q[at_q], vectors[at_b])
        there = ~np.isnan(values)
        best.add(at_q[there], start + at_b[there], values[there])  # nodes are in order of ids
    ends = np.searchsorted(best.query, np.arange(len(ids) + 1))
    return [list(zip(best.score[a:b].tolist(), best.id[a:b].tolist())) for a, b in zip(ends, ends[1:])]


def _searcher(shared, k: int, metric: str, rerank_k: int | None, threshold: float | None, filtered: bool, exclude_self: bool, options: BuildOptions, floor: float | None, codec, complete: bool):
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def one(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(edges) or not len(rows):
            return pd.DataFrame(columns=columns)
        g = Graph.from_rows(edges, rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()), metric, options, codec.value.m if codec else 0)
        good = np.isin(g.ids, rows.loc[rows["ok"].fillna(False).astype(bool), "vec_id"]) if filtered else np.ones(len(g.ids), dtype=bool)
        allowed, place = good.tolist(), {int(v): n for n, v in enumerate(g.ids)}

        def accept(i: int):
            own = place.get(i) if exclude_self else None
            if filtered:
                return lambda n: allowed[n] and n != own
            return None if own is None else lambda n: n != own

        ids, block = shared.value
        taken = codec.value if codec else None
        found = []
        for at in (slice(x, x + search.ASKING) for x in range(0, len(ids), search.ASKING)):
            own = [accept(int(i)) for i in ids[at]]
            if threshold is None:
                walks = list(g.search_all(block[at], k, rerank_k, own, floor, taken))
            else:
                walks = [g.search(q, k, rerank_k, threshold, a, floor, taken) for q, a in zip(block[at], own)]
            results = completed(g, ids[at], block[at], walks, k, good, exclude_self) if complete else [r.results for r in walks]
            n = [len(best) for best in results]
            scores, nodes = np.array([x for best in results for x in best], dtype=np.float64).reshape(-1, 2).T
            spent = np.array([(r.visited, r.expanded, r.expanded_base, r.reranked) for r in walks], dtype=np.int64).repeat(n, axis=0)
            found.append((ids[at].repeat(n), g.ids[nodes.astype(np.int64)], scores, *spent.T, np.repeat([r.worst_approximate for r in walks], n)))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found)))))

    return one


def graph_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", rerank_k: int | None = None, threshold: float | None = None, accept: Column | None = None, exclude_self: bool = True, options: BuildOptions = BuildOptions(), block_bytes: int = search.BLOCK_BYTES, floor: float | None = None, codec=None, complete: bool = False) -> DataFrame:
    """Approximate search in every segment, ranked together; counters are sums over segments.

    accept: a condition on rows of ``vectors``.  Queries go to the segments in
    blocks of bounded size.  codec: walk by the codes that ``with_codes`` has put
    beside the neighbours, and rescore the ``rerank_k`` best as in ``Graph.search``.
    complete: let products of the queries with all rows of a segment find what the walk
    has missed, so that results are those of an exact search, with its scores and ties.
    """
    if complete and threshold is not None:
        raise ValueError("a complete search takes no threshold")
    spark = importable(vectors.sparkSession)
    if codec is not None and "neighbor_codes" not in graph.columns:
        raise ValueError("this graph has no codes beside its neighbours")
    base = vectors.select("segment", "vec_id", "embedding", (accept if accept is not None else F.lit(True)).alias("ok"))
    shared_codec = spark.sparkContext.broadcast(codec) if codec is not None else None
    out = None
    for ids, block in search.query_blocks(queries, "vec_id", "embedding", block_bytes):
        shared = spark.sparkContext.broadcast((ids, block.astype(np.float64)))

        part = graph.drop("scores").groupBy("segment").cogroup(base.groupBy("segment")).applyInPandas(_searcher(shared, k, metric, rerank_k, threshold, accept is not None, exclude_self, options, floor, shared_codec, complete), RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)


def stats(graph: DataFrame) -> DataFrame:
    """Nodes, edges, average and largest degree of each layer."""
    degree = F.size("neighbors")
    return graph.groupBy("level").agg(F.count("*").alias("nodes"), F.sum(degree).cast("long").alias("edges"), F.avg(degree).alias("average_degree"), F.max(degree).cast("long").alias("max_degree"))


def repair(graph: DataFrame, deleted: DataFrame, vectors: DataFrame, metric: str = "cosine", options: BuildOptions = BuildOptions()) -> DataFrame:
    """Graphs without the deleted ids, in each segment on its own; an emptied segment has no rows."""
    importable(graph.sparkSession)
    rows = vectors.select("segment", "vec_id", "embedding").join(deleted.select("vec_id", F.lit(True).alias("gone")).distinct(), "vec_id", "left")

    def one(key, edges: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(edges):
            return edges
        g = Graph.from_rows(edges, pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()), metric, options)
        gone = set(pdf.loc[pdf["gone"].notna(), "vec_id"])
        g.delete({i for i, v in enumerate(g.ids) if v in gone})
        return g.remove_deleted().rows(int(edges["segment"].iloc[0]))

    return graph.groupBy("segment").cogroup(rows.groupBy("segment")).applyInPandas(one, GRAPH)


def rescored(graph: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    """Edge scores under other vectors; the topology stays."""
    v = vectors.select("vec_id", "embedding")
    edges = graph.select("segment", "level", "node", "entry", F.posexplode("neighbors").alias("place", "vec_id"))
    left = v.withColumnsRenamed({"vec_id": "node", "embedding": "own"})
    scored = edges.join(v, "vec_id").join(left, "node").withColumn("score", V.score(metric, F.col("own"), F.col("embedding")))
    lists = scored.groupBy("segment", "level", "node").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("x"))
    empty = F.array().cast("array<long>"), F.array().cast("array<double>")
    return graph.select("segment", "level", "node", "entry").join(lists, ["segment", "level", "node"], "left").select("segment", "level", "node", F.coalesce(F.col("x.vec_id"), empty[0]).alias("neighbors"), F.coalesce(F.col("x.score"), empty[1]).alias("scores"), "entry")


def with_codes(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """Each node with its code and its neighbours' codes beside it, in order, so that one row serves a step of the search."""
    edges = graph.select("segment", "level", "node", F.posexplode("neighbors").alias("place", "vec_id")).join(codes.select("vec_id", F.col("codes").alias("near")), "vec_id")
    lists = edges.groupBy("segment", "level", "node").agg(F.array_sort(F.collect_list(F.struct("place", "near"))).alias("x"))
    own = graph.join(codes.select(F.col("vec_id").alias("node"), "codes"), "node")
    return own.join(lists, ["segment", "level", "node"], "left").withColumn("neighbor_codes", F.coalesce(F.col("x.near"), F.array().cast("array<array<int>>"))).drop("x")
