"""Kernels of the robust-pruned proximity graph: batched beam search, pruning and insertion in numpy.

One call works on one shard that fits in a task. Many queries walk the graph in step, so every operation is an
array operation over the batch.
"""

from __future__ import annotations

import numpy as np

FAR = np.float32(np.inf)


def _gather_d2(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each query to the rows listed for it: (b, c)."""
    diff = x[ids] - q[:, None, :]
    return np.einsum("bcd,bcd->bc", diff, diff, optimize=False)


def beam_search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk the graph from the entry rows nearest to each query. Returns (ids, squared distances), both (b, beam), ascending.

    Free places hold id -1 and an infinite distance. The walk of a query ends when every row in its beam has been expanded.
    """
    b, n = len(q), len(x)
    e = x[entries]
    start = np.maximum((q * q).sum(1)[:, None] + (e * e).sum(1)[None] - 2 * q @ e.T, 0)
    m = min(beam, len(entries))
    first = np.argpartition(start, m - 1, axis=1)[:, :m] if m < len(entries) else np.tile(np.arange(m), (b, 1))
    ids = np.full((b, beam), -1, np.int32)
    ids[:, :m] = entries[first]
    d2 = np.full((b, beam), FAR, np.float32)
    d2[:, :m] = _gather_d2(x, ids[:, :m], q)
    done = np.ones((b, beam), bool)
    done[:, :m] = False
    seen = np.zeros((b, n), bool)
    np.put_along_axis(seen, ids[:, :m].astype(np.int64), True, 1)
    order = np.argsort(d2, axis=1, kind="stable")
    ids, d2, done = (np.take_along_axis(a, order, 1) for a in (ids, d2, done))
    at = np.arange(b)
    while True:
        open_ = ~done
        live = open_.any(1)
        at = np.flatnonzero(live)
        if not len(at):
            return ids, d2
        pick = open_[at].argmax(1)
        node = ids[at, pick]
        done[at, pick] = True
        near = links[node]
        ok = near >= 0
        safe = np.where(ok, near, 0)
        ok &= ~seen[at[:, None], safe]
        rows, cols = np.nonzero(ok)
        new = safe[rows, cols]
        seen[at[rows], new] = True
        diff = x[new] - q[at[rows]]
        dist = np.full(near.shape, FAR, np.float32)
        dist[rows, cols] = np.einsum("cd,cd->c", diff, diff)
        worst = d2[at, -1]
        better = dist < worst[:, None]
        hit = better.any(1)
        if not hit.any():
            continue
        a = at[hit]
        all_ids = np.concatenate([ids[a], np.where(better[hit], near[hit], -1)], 1)
        all_d2 = np.concatenate([d2[a], np.where(better[hit], dist[hit], FAR)], 1)
        all_done = np.concatenate([done[a], ~better[hit]], 1)
        order = np.argsort(all_d2, axis=1, kind="stable")[:, :beam]
        ids[a], d2[a], done[a] = (np.take_along_axis(z, order, 1) for z in (all_ids, all_d2, all_done))


def robust_prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Choose at most ``degree`` diverse out-links of each of ``rows`` from its candidates (-1 where free).

    From near to far, a candidate is kept unless a kept one is nearer to it, by the factor ``alpha``, than the row is.
    """
    cand = np.sort(cand, axis=1)
    same = np.zeros(cand.shape, bool)
    same[:, 1:] = cand[:, 1:] == cand[:, :-1]
    bad = (cand < 0) | same | (cand == rows[:, None])
    rel = x[np.where(bad, 0, cand)] - x[rows][:, None, :]
    d2 = np.einsum("bcd,bcd->bc", rel, rel)
    d2[bad] = FAR
    order = np.argsort(d2, axis=1, kind="stable")
    order = order[:, : max(1, int((~bad).sum(1).max(initial=1)))]
    cand, d2, bad = (np.take_along_axis(a, order, 1) for a in (cand, d2, bad))
    rel = np.take_along_axis(rel, order[:, :, None], 1)
    pair = np.maximum(d2[:, :, None] + d2[:, None, :] - 2 * rel @ rel.transpose(0, 2, 1), 0) if rel.shape[1] > 1 else np.zeros((len(rows), 1, 1), np.float32)
    pair[~np.isfinite(pair)] = FAR
    alive = ~bad
    out = np.full((len(rows), degree), -1, np.int32)
    at = np.arange(len(rows))
    a2 = np.float32(alpha * alpha)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        out[has, k] = cand[has, pick[has]]
        covered = a2 * pair[at, pick] <= d2
        covered[at, pick] = True
        alive &= ~(covered & has[:, None])
    return out


def _exact(x: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of ``among`` for each of ``rows``, by blocks."""
    k = min(k, len(among))
    a, out = x[among], []
    sq = (a * a).sum(1)
    for s in range(0, len(rows), 512):
        d2 = sq[None] - 2 * x[rows[s : s + 512]] @ a.T
        out.append(among[np.argpartition(d2, k - 1, axis=1)[:, :k]])
    return np.concatenate(out).astype(np.int32)


def build(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Graph over the rows of ``x`` (all distinct). Returns (links (n, degree) with -1 where free, entry rows).

    Rows come in a seeded random order, in batches: every row of a batch is searched for in the graph of the rows
    before, takes pruned links to what the search met and to its nearest rows in its own batch, and is then offered
    as a link to those rows in turn, which prune again if they have too many.
    """
    n = len(x)
    x = x - x.mean(0, dtype=np.float64).astype(np.float32)  # smaller numbers, less cancellation
    links = np.full((n, degree), -1, np.int32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n).astype(np.int32)
    entries = np.sort(order[: int(min(n, max(32, 2 * np.sqrt(n))))])
    for s in range(0, n, batch):
        rows = order[s : s + batch]
        cand = _exact(x, rows, rows, beam // 2 + 1)
        if s:
            known = entries[np.isin(entries, order[:s])] if s < len(entries) else entries
            parts = [beam_search(x, links, known, x[rows[i : i + 512]], beam)[0] for i in range(0, len(rows), 512)]
            cand = np.concatenate([np.concatenate(parts), cand], 1)
        for i in range(0, len(rows), 256):
            links[rows[i : i + 256]] = robust_prune(x, rows[i : i + 256], cand[i : i + 256], degree, alpha)
        _offer_back(x, links, rows, degree, alpha)
    return links, entries.astype(np.int32)


def _offer_back(x: np.ndarray, links: np.ndarray, rows: np.ndarray, degree: int, alpha: float) -> None:
    """Offer each of ``rows`` to the rows it links to."""
    src, pos = np.nonzero(links[rows] >= 0)
    giver, taker = rows[src], links[rows][src, pos]
    order = np.argsort(taker, kind="stable")
    giver, taker = giver[order], taker[order]
    who, start, count = np.unique(taker, return_index=True, return_counts=True)
    for lo in range(0, len(who), 256):
        w, st, ct = who[lo : lo + 256], start[lo : lo + 256], count[lo : lo + 256]
        wide = int(ct.max())
        # a row that very many others chose is pruned in several rounds, so that no batch is wide
        for off in range(0, wide, 64):
            col = off + np.arange(min(64, wide - off))
            use = ct > off
            offered = np.where(col[None] < ct[use, None], giver[np.minimum(st[use, None] + col[None], len(giver) - 1)], -1)
            both = np.concatenate([links[w[use]], offered.astype(np.int32)], 1)
            links[w[use]] = robust_prune(x, w[use], both, degree, alpha)


def search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, k: int, beam: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k rows nearest to each query that the walk met, with exact double-precision distances.

    Twice as many are measured exactly, and rows at the distance of the k-th are all returned, so that ties can be broken by
    id later; unused places hold id -1 and an infinite distance.
    """
    mean = x.mean(0, dtype=np.float64).astype(np.float32)
    xc, qc = x - mean, q - mean
    ids = np.concatenate([beam_search(xc, links, entries, qc[s : s + batch], beam)[0][:, : 2 * k] for s in range(0, len(q), batch)])
    dist = np.full(ids.shape, np.inf)
    for s in range(0, len(q), 2048):
        i = ids[s : s + 2048]
        diff = x[np.maximum(i, 0)].astype(np.float64) - q[s : s + 2048, None, :].astype(np.float64)
        dist[s : s + 2048] = np.where(i >= 0, np.sqrt(np.einsum("bcd,bcd->bc", diff, diff)), np.inf)
    if ids.shape[1] > k:
        far = dist > np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        ids, dist = np.where(far, -1, ids), np.where(far, np.inf, dist)
    return ids, dist
