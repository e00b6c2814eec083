"""Communities of a graph: Louvain, Leiden and Walktrap.

Their moves are sequential: each depends on all before it. The graph (bounded by MAX_EDGES) therefore goes to one task per
run, and several seeded runs go side by side; everything around them - graph, modularity, checks - is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.graph import communities_connected, modularity
from orrery.plans.cut import cut

#: Edges that one task holds; a larger graph is an error (coarsen it by community_graph first).
MAX_EDGES = 20_000_000
#: Walktrap holds vertices x vertices numbers.
WALKTRAP_VERTICES = 4000
MAX_LEVELS = 64


class _Graph:
    """Neighbour lists of both directions; loops apart."""

    def __init__(self, n: int, src, dst, w):
        self.n = n
        loop = src == dst
        self.loops = np.bincount(src[loop], weights=w[loop], minlength=n) if loop.any() else np.zeros(n)
        s, t, v = np.concatenate([src[~loop], dst[~loop]]), np.concatenate([dst[~loop], src[~loop]]), np.concatenate([w[~loop], w[~loop]])
        order = np.argsort(s, kind="stable")
        self.to, self.w = t[order], v[order]
        self.start = np.searchsorted(s[order], np.arange(n + 1))
        self.strength = np.bincount(s, weights=v, minlength=n) + 2 * self.loops
        self.m = self.strength.sum() / 2

    def near(self, u: int):
        a, b = self.start[u], self.start[u + 1]
        return self.to[a:b], self.w[a:b]

    def merged(self, label: np.ndarray) -> _Graph:
        k = int(label.max()) + 1 if len(label) else 0
        src = np.repeat(np.arange(self.n), np.diff(self.start))
        half = src < self.to
        a, b = label[src[half]], label[self.to[half]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        code, inverse = np.unique(lo * max(k, 1) + hi, return_inverse=True)
        w = np.bincount(inverse, weights=self.w[half], minlength=len(code))
        loops = np.bincount(label, weights=self.loops, minlength=k)
        return _Graph(k, np.concatenate([code // max(k, 1), np.flatnonzero(loops)]), np.concatenate([code % max(k, 1), np.flatnonzero(loops)]), np.concatenate([w, loops[loops > 0]]))


def _dense(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1].ravel()


def _local_move(g: _Graph, label: np.ndarray, resolution: float, rng: np.random.Generator, within: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Moves single vertices while the quality grows; with ``within`` only among vertices of one parent."""
    label = label.copy()
    volume = np.bincount(label, weights=g.strength, minlength=g.n)
    members = np.bincount(label, minlength=g.n)
    least, moved_any = 1e-12 * max(1.0, g.m), False
    queue, waiting = list(rng.permutation(g.n)), np.ones(g.n, bool)
    at = 0
    while at < len(queue):
        u = queue[at]
        at += 1
        waiting[u] = False
        to, w = g.near(u)
        if within is not None:
            same = within[to] == within[u]
            to, w = to[same], w[same]
        own, k = label[u], g.strength[u]
        volume[own] -= k
        members[own] -= 1
        names, inverse = np.unique(np.append(label[to], own), return_inverse=True)
        links = np.bincount(inverse, weights=np.append(w, 0.0))
        gain = links - resolution * k * volume[names] / (2 * g.m)
        stay = gain[np.searchsorted(names, own)]
        pick = int(gain.argmax())
        best, target = gain[pick], names[pick]
        if best < -least and stay < -least:  # better alone
            free = own if members[own] == 0 else int(np.flatnonzero(members == 0)[0])
            best, target = 0.0, free
        if best > stay + least and target != own:
            label[u], moved_any = target, True
            for v in to[label[to] != target].tolist():
                if not waiting[v]:
                    waiting[v] = True
                    queue.append(v)
        volume[label[u]] += k
        members[label[u]] += 1
    return label, moved_any


def louvain(g: _Graph, resolution: float, rng: np.random.Generator) -> np.ndarray:
    whole, level = np.arange(g.n), g
    for _ in range(MAX_LEVELS):
        label, moved = _local_move(level, np.arange(level.n), resolution, rng)
        if not moved:
            break
        label = _dense(label)
        whole = label[whole]
        level = level.merged(label)
    return _dense(whole)


def _connected_parts(g: _Graph, label: np.ndarray) -> np.ndarray:
    part, n = np.full(g.n, -1), 0
    for s in range(g.n):
        if part[s] >= 0:
            continue
        part[s], stack = n, [s]
        while stack:
            u = stack.pop()
            to, w = g.near(u)
            for v in to[(label[to] == label[u]) & (part[to] < 0) & (w > 0)].tolist():
                if part[v] < 0:
                    part[v] = n
                    stack.append(v)
        n += 1
    return part


def leiden(g: _Graph, resolution: float, rng: np.random.Generator, n_iterations: int = 10) -> np.ndarray:
    """Local moves, refinement inside each community, aggregation by the refined parts; repeated until nothing moves."""
    whole = np.arange(g.n)
    for _ in range(max(1, n_iterations)):
        before, level, back = whole.copy(), g, np.arange(g.n)
        label = _dense(whole)
        for _ in range(MAX_LEVELS):
            label, moved = _local_move(level, label, resolution, rng)
            label = _dense(label)
            refined, _ = _local_move(level, np.arange(level.n), resolution, rng, within=label)
            refined = _dense(_connected_parts(level, _dense(refined)))
            if not moved or refined.max() + 1 == level.n:
                break
            parent = np.zeros(refined.max() + 1, int)
            parent[refined] = label
            back, level, label = refined[back], level.merged(refined), _dense(parent)
        whole = _dense(_connected_parts(g, label[back]))
        if len(np.unique(np.stack([before, whole]), axis=1).T) == len(np.unique(before)) == len(np.unique(whole)):
            break
    return whole


def walktrap(n: int, src, dst, w, steps: int = 4) -> np.ndarray:
    """Agglomeration by distances of short random walks; repeated edges add up, each vertex has a loop of its mean weight. Cut at the best modularity."""
    if n > WALKTRAP_VERTICES:
        raise ValueError(f"walktrap is limited to {WALKTRAP_VERTICES} vertices")
    a = np.zeros((n, n))
    off = src != dst
    np.add.at(a, (src[off], dst[off]), w[off])
    np.add.at(a, (dst[off], src[off]), w[off])
    plain, count = a.copy(), (a > 0).sum(1)
    a[np.arange(n), np.arange(n)] = np.where(count > 0, a.sum(1) / np.maximum(count, 1), 1.0)
    degree = a.sum(1)
    walk = np.linalg.matrix_power(a / degree[:, None], steps)
    scaled = walk / np.sqrt(degree)[None]
    size, alive = {i: 1 for i in range(n)}, {i: scaled[i] for i in range(n)}
    near = {i: set(np.flatnonzero(plain[i]).tolist()) for i in range(n)}
    m = plain.sum() / 2
    if m == 0:
        return np.arange(n)
    import heapq

    def cost(i, j):
        d = alive[i] - alive[j]
        return size[i] * size[j] / (size[i] + size[j]) * float(d @ d) / n

    heap = [(cost(i, j), i, j) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    parent, inside, volume = np.arange(2 * n), dict.fromkeys(range(n), 0.0), {i: plain[i].sum() for i in range(n)}
    between = {i: {j: plain[i, j] for j in near[i]} for i in range(n)}
    q = sum(inside[i] / m - (volume[i] / (2 * m)) ** 2 for i in range(n))
    best, keep, fresh = q, 0, n
    merges = []
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in alive or j not in alive:
            continue
        w_ij = between[i].get(j, 0.0)
        q += w_ij / m - 2 * volume[i] * volume[j] / (2 * m) ** 2
        parent[i] = parent[j] = fresh
        alive[fresh] = (size[i] * alive[i] + size[j] * alive[j]) / (size[i] + size[j])
        size[fresh], inside[fresh], volume[fresh] = size[i] + size[j], inside[i] + inside[j] + w_ij, volume[i] + volume[j]
        links: dict[int, float] = {}
        for part in (i, j):
            for v, x in between.pop(part).items():
                if v not in (i, j):
                    links[v] = links.get(v, 0.0) + x
                    between[v].pop(part, None)
        del alive[i], alive[j]
        between[fresh] = links
        for v, x in links.items():
            between[v][fresh] = x
            heapq.heappush(heap, (cost(v, fresh), v, fresh))
        merges.append((i, j))
        fresh += 1
        if q > best + 1e-15:
            best, keep = q, len(merges)
    label = np.arange(n + keep)
    for k, (i, j) in enumerate(merges[:keep]):
        label[i] = label[j] = n + k
    for k in range(n + keep - 1, -1, -1):
        label[k] = label[label[k]] if label[k] != k else k
    return _dense(label[:n])


@dataclass(frozen=True)
class Clustering:
    """membership: id, community (1-based); modularity and n_communities of the best run."""

    membership: DataFrame
    modularity: float | None
    n_communities: int
    method: str

    def connected(self, edges: DataFrame) -> DataFrame:
        return communities_connected(edges, self.membership)

    def __repr__(self) -> str:
        return f"Clustering({self.method}, communities={self.n_communities}, modularity={self.modularity})"


def graph_cluster(edges: DataFrame, vertices: DataFrame, method: str = "leiden", resolution: float = 1.0, n_iterations: int = 10, n_runs: int = 1, steps: int = 4, seed: int = 1) -> Clustering:
    """The partition of best modularity over ``n_runs`` seeded runs. Isolated vertices are communities of their own."""
    if method not in ("leiden", "louvain", "walktrap"):
        raise ValueError("method must be leiden, louvain or walktrap")
    if resolution <= 0 or n_runs < 1:
        raise ValueError("resolution and n_runs must be positive")
    e = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "cluster-edges")
    n_vertices = vertices.count()
    if method == "walktrap" and n_vertices > WALKTRAP_VERTICES:
        raise ValueError(f"walktrap is limited to {WALKTRAP_VERTICES} vertices")
    if e.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    runs = 1 if method == "walktrap" else n_runs
    each = F.explode(F.array(*[F.lit(seed + r) for r in range(runs)])).alias("run")

    def one(key, left, right):
        ids = np.sort(right["id"].to_numpy())
        src, dst = (np.searchsorted(ids, left[c].to_numpy()) for c in ("src", "dst"))
        w = left["weight"].to_numpy()
        keep = w > 0
        src, dst, w = src[keep], dst[keep], w[keep]
        order = np.lexsort((dst, src))
        src, dst, w = src[order], dst[order], w[order]
        run = key[0].as_py()
        if method == "walktrap":
            label = walktrap(len(ids), src, dst, w, steps)
        else:
            g, rng = _Graph(len(ids), src, dst, w), np.random.default_rng(run)
            label = np.arange(len(ids)) if g.m == 0 else louvain(g, resolution, rng) if method == "louvain" else leiden(g, resolution, rng, n_iterations)
        first = np.unique(label, return_index=True)[1]
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(1, len(first) + 1)
        return pa.table({"run": pa.array(np.full(len(ids), run, np.int32)), "id": ids, "community": rank[label] if len(ids) else np.zeros(0, np.int64)})

    found = cut(e.select("src", "dst", "weight", each).groupBy("run").cogroup(vertices.select("id", each).groupBy("run")).applyInArrow(one, "run int, id bigint, community bigint"), "clusterings")
    scored = []
    for r in range(runs):
        member = found.where(F.col("run") == seed + r).select("id", "community")
        s = modularity(e, member, resolution).first()
        scored.append((s.modularity, s.n_communities, member))
    best = max(scored, key=lambda x: (x[0] is not None, x[0] or 0.0))
    return Clustering(best[2], best[0], best[1], method)
