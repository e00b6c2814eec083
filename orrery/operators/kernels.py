"""Numpy kernels of the layouts. Each works on one bounded graph inside one task."""

from __future__ import annotations

import numpy as np

CLIP = 4.0


def _add(y: np.ndarray, at: np.ndarray, step: np.ndarray) -> None:
    for c in range(y.shape[1]):
        y[:, c] += np.bincount(at, weights=step[:, c], minlength=len(y))


def spectral_init(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, dims: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Leading eigenvectors of the normalized graph after the trivial one, by block power iteration; greatest value 10, jittered."""
    if not len(src):
        return rng.uniform(-10, 10, (n, dims))
    degree = np.bincount(src, weights=w, minlength=n)
    root = np.sqrt(np.maximum(degree, 1e-12))
    value = w / (root[src] * root[dst])
    trivial = root / np.linalg.norm(root)
    width = max(dims + 6, 8)

    def times(v):
        return np.stack([np.bincount(src, weights=value * v[dst, c], minlength=n) for c in range(v.shape[1])], 1)

    v = rng.standard_normal((n, width))
    for _ in range(iterations):
        v -= trivial[:, None] * (trivial @ v)
        v = np.linalg.qr(0.5 * (v + times(v)))[0]
    v -= trivial[:, None] * (trivial @ v)
    v = np.linalg.qr(v)[0]
    values, small = np.linalg.eigh(v.T @ times(v))
    y = (v @ small)[:, np.argsort(values)[::-1][:dims]]
    y -= y.mean(0)
    y *= 10 / max(np.abs(y).max(), 1e-12)
    return y + rng.normal(0, 1e-4, y.shape)


def umap_optimize(y: np.ndarray, src: np.ndarray, dst: np.ndarray, eps: np.ndarray, a: float, b: float, n_epochs: int, rng: np.random.Generator, learning_rate: float = 1.0, negatives: int = 5, repulsion: float = 1.0) -> np.ndarray:
    """Sampled attraction and repulsion over ``n_epochs``; edges are drawn as often as their schedule says.

    One synchronous regime: the edges due in an epoch are applied in a few shuffled portions.
    """
    y, n = y.astype(float).copy(), len(y)
    use = eps <= n_epochs
    src, dst, eps = src[use], dst[use], eps[use]
    due = eps.copy()
    for epoch in range(1, n_epochs + 1):
        alpha = learning_rate * (1 - (epoch - 1) / n_epochs)
        at = np.flatnonzero(due <= epoch)
        due[at] += eps[at]
        rng.shuffle(at)
        for part in np.array_split(at, max(1, min(4, len(at) // 64))):
            if not len(part):
                continue
            i, j = src[part], dst[part]
            diff = y[i] - y[j]
            d2 = (diff * diff).sum(1)
            safe = np.where(d2 > 0, d2, 1.0)
            pull = np.where(d2 > 0, -2 * a * b * safe**b / (safe * (a * safe**b + 1)), 0.0)
            step = alpha * np.clip(pull[:, None] * diff, -CLIP, CLIP)
            _add(y, i, step)
            _add(y, j, -step)
            head = np.repeat(i, negatives)
            other = rng.integers(0, n, len(head))
            ok = other != head
            head, other = head[ok], other[ok]
            diff = y[head] - y[other]
            d2 = (diff * diff).sum(1)
            push = 2 * repulsion * b / ((0.001 + d2) * (a * d2**b + 1))
            step = alpha * np.where(d2[:, None] > 0, np.clip(push[:, None] * diff, -CLIP, CLIP), CLIP)
            _add(y, head, step)
    return y


def _drawn(ids: np.ndarray, seed: int, epoch: int, width: int, below: int) -> np.ndarray:
    """``width`` numbers under ``below`` for each id, made of the id, the seed and the epoch alone (a 64-bit mixing function)."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed * 1_000_003 + epoch) & (2**64 - 1))
        z = z * np.uint64(0xD1342543DE82EF95) + np.arange(1, width + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) % np.uint64(below)).astype(np.int64)


def umap_refine(y: np.ndarray, near: np.ndarray, eps: np.ndarray, ids: np.ndarray, against: np.ndarray, a: float, b: float, n_epochs: int, seed: int, learning_rate: float = 1.0, negatives: int = 5) -> np.ndarray:
    """New rows ``y`` (m, q) moved among fixed rows: pulled to their neighbours ``near`` (m, k, q) as often as the schedule ``eps``
    (m, k; infinite for none) says, and with every pull pushed from ``negatives`` rows of ``against``.

    All rows at once; a row's path depends on its own neighbours and id alone, so any batching gives the same result.
    """
    y, m, k = y.astype(float).copy(), *eps.shape
    due = eps.copy()
    for epoch in range(1, n_epochs + 1):
        alpha = learning_rate * (1 - (epoch - 1) / n_epochs)
        now = due <= epoch
        due = np.where(now, due + eps, due)
        diff = y[:, None] - near
        d2 = (diff * diff).sum(2)
        safe = np.where(d2 > 0, d2, 1.0)
        pull = np.where(now & (d2 > 0), -2 * a * b * safe**b / (safe * (a * safe**b + 1)), 0.0)
        y += alpha * np.clip(pull[:, :, None] * diff, -CLIP, CLIP).sum(1)
        if not negatives:
            continue
        far = against[_drawn(ids, seed, epoch, k * negatives, len(against))]
        diff = y[:, None] - far
        d2 = (diff * diff).sum(2)
        push = 2 * b / ((0.001 + d2) * (a * d2**b + 1))
        step = np.where(d2[:, :, None] > 0, np.clip(push[:, :, None] * diff, -CLIP, CLIP), CLIP)
        y += alpha * (np.repeat(now, negatives, axis=1)[:, :, None] * step).sum(1)
    return y


def exact_repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum of q^2 (y_i - y_j) for each row, and the sum of q over ordered pairs; in single precision, strip by strip, in place."""
    f = y.astype(np.float32)
    out, z = np.empty_like(y), 0.0
    cols = [np.ascontiguousarray(f[:, c]) for c in range(f.shape[1])]
    step = max(16, 500_000 // max(1, len(y)))
    for s in range(0, len(y), step):
        p = f[s : s + step]
        q = np.subtract.outer(p[:, 0], cols[0])
        q *= q
        for c in range(1, len(cols)):
            t = np.subtract.outer(p[:, c], cols[c])
            t *= t
            q += t
        q += 1
        np.reciprocal(q, out=q)
        z += float(q.sum(dtype=np.float64)) - len(p)  # less the rows themselves, whose pull is nil
        q *= q
        out[s : s + step] = q.sum(1)[:, None] * p - q @ f
    return out, z


def grid_size(n: int) -> int:
    return 64 if n < 10_000 else 128 if n < 50_000 else 256


def fft_repulsion(y: np.ndarray, grid: int | None = None) -> tuple[np.ndarray, float]:
    """As :func:`exact_repulsion` for two dimensions, with charges spread bilinearly on a grid and convolved by FFT."""
    n, g = len(y), grid or grid_size(len(y))
    low = y.min(0)
    h = max((y.max(0) - low).max() / (g - 1), 1e-9)
    at = (y - low) / h
    cell = np.clip(np.floor(at).astype(int), 0, g - 2)
    f = at - cell
    corners = [(dx, dy, (f[:, 0] if dx else 1 - f[:, 0]) * (f[:, 1] if dy else 1 - f[:, 1])) for dx in (0, 1) for dy in (0, 1)]
    flat = [(cell[:, 0] + dx) * g + cell[:, 1] + dy for dx, dy, _ in corners]

    def spread(charge):
        total = np.zeros(g * g)
        for idx, (_, _, w) in zip(flat, corners, strict=True):
            total += np.bincount(idx, weights=w * charge, minlength=g * g)
        return total.reshape(g, g)

    o = np.arange(2 * g)
    o = np.where(o < g, o, o - 2 * g) * h
    d2 = o[:, None] ** 2 + o[None] ** 2
    k1, k2 = np.fft.rfft2(1 / (1 + d2)), np.fft.rfft2(1 / (1 + d2) ** 2)

    def field(charge_hat, kernel):
        m = np.fft.irfft2(charge_hat * kernel, (2 * g, 2 * g))[:g, :g].ravel()
        return sum(w * m[idx] for idx, (_, _, w) in zip(flat, corners, strict=True))

    one, hx, hy = (np.fft.rfft2(spread(c), (2 * g, 2 * g)) for c in (np.ones(n), y[:, 0], y[:, 1]))
    z = field(one, k1).sum() - n
    phi = field(one, k2)
    return np.stack([phi * y[:, 0] - field(hx, k2), phi * y[:, 1] - field(hy, k2)], 1), max(z, 1e-12)


EXACT_ROWS = 3000


def tsne_optimize(y: np.ndarray, src: np.ndarray, dst: np.ndarray, p: np.ndarray, early_iter: int = 250, n_iter: int = 500, early_exaggeration: float = 12.0, exaggeration: float = 1.0, learning_rate: float | None = None, momentum: tuple[float, float] = (0.8, 0.8), min_gain: float = 0.01, max_step_norm: float = 5.0, method: str = "auto", record: bool = False) -> tuple[np.ndarray, list[float]]:
    """Gradient descent with gains and momentum; returns the layout and, if recorded, the cost every 50 steps."""
    y, n = y.astype(float).copy(), len(y)
    rate = learning_rate or max(n / 12.0, 1e-3)
    if method == "auto":
        method = "exact" if n <= EXACT_ROWS or y.shape[1] != 2 else "fft"
    if method not in ("exact", "fft"):
        raise ValueError("negative_gradient_method must be auto, exact or fft")
    step, gains, costs = np.zeros_like(y), np.ones_like(y), []
    for it in range(early_iter + n_iter):
        early = it < early_iter
        ex, m = (early_exaggeration, momentum[0]) if early else (exaggeration, momentum[1])
        diff = y[src] - y[dst]
        q = 1 / (1 + (diff * diff).sum(1))
        pull = np.zeros_like(y)
        _add(pull, src, (ex * p * q)[:, None] * diff)
        push, z = exact_repulsion(y) if method == "exact" else fft_repulsion(y)
        if record and it % 50 == 0:
            costs.append(float((p * np.log((p + 1e-9) / (q / z + 1e-9))).sum()))
        grad = pull - push / z
        flip = np.sign(grad) != np.sign(step)
        gains = np.maximum(np.where(flip, gains + 0.2, gains * 0.8 + min_gain), min_gain)
        step = m * step - rate * gains * grad
        if max_step_norm:
            norm = np.sqrt((step * step).sum(1, keepdims=True))
            step *= np.minimum(1.0, max_step_norm / np.maximum(norm, 1e-12))
        y += step
        y -= y.mean(0)
    return y, costs


def padded(lists: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different length as one array, with the mask of its used places."""
    sizes = np.array([len(x) for x in lists])
    mask = np.arange(max(1, int(sizes.max(initial=0))))[None] < sizes[:, None]
    out = np.zeros(mask.shape)
    out[mask] = np.concatenate([np.asarray(x, float) for x in lists]) if len(lists) else []
    return out, mask


def perplexity_rows(d: np.ndarray, perplexity: float, mask: np.ndarray | None = None) -> np.ndarray:
    """Conditional probabilities (rows of distances) of the given perplexity: beta by at most 200 bisections from 1 on the
    entropy, doubling or halving while an end is open. All rows are searched in step; finished ones rest."""
    mask = np.ones(d.shape, bool) if mask is None else mask
    d2 = np.where(mask, d * d, 0.0)
    goal, beta = np.log(perplexity), np.ones(len(d))
    lo, hi, live = np.full(len(d), -np.inf), np.full(len(d), np.inf), np.arange(len(d))
    for _ in range(200):
        x, m, b = d2[live], mask[live], beta[live]
        e = np.where(m, np.exp(-b[:, None] * x), 0.0)
        s = np.maximum(e.sum(1), 1e-300)
        off = b * (x * e).sum(1) / s + np.log(s) - goal
        go = np.abs(off) >= 1e-5
        live, b, up = live[go], b[go], off[go] > 0
        if not len(live):
            break
        lo[live], hi[live] = np.where(up, b, lo[live]), np.where(up, hi[live], b)
        more = np.where(np.isinf(hi[live]), b * 2, (b + hi[live]) / 2)
        less = np.where(np.isinf(lo[live]), b / 2, (b + lo[live]) / 2)
        beta[live] = np.where(up, more, less)
    e = np.where(mask, np.exp(-beta[:, None] * d2), 0.0)
    return e / np.maximum(e.sum(1, keepdims=True), 1e-300)


def smooth_rows(d: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of rows of distances, before the floor: rho the least positive distance (else 0), sigma by at most 64
    bisections from 1 on the mass log2(k), doubling while no upper end is known; the best value met is kept."""
    positive = np.where(mask & (d > 0), d, np.inf).min(1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    target = np.log2(np.maximum(mask.sum(1), 1).astype(float))
    n = len(d)
    lo, hi, s, best, miss, live = np.zeros(n), np.full(n, np.inf), np.ones(n), np.ones(n), np.full(n, np.inf), np.arange(n)
    over = np.maximum(d - rho[:, None], 0.0)
    for _ in range(64):
        at = s[live]
        mass = np.where(mask[live], np.exp(-over[live] / np.maximum(at, 1e-12)[:, None]), 0.0).sum(1)
        off = np.abs(mass - target[live])
        better = off < miss[live]
        best[live], miss[live] = np.where(better, at, best[live]), np.minimum(off, miss[live])
        go = off >= 1e-5
        up = (mass > target[live])[go]
        live, at = live[go], at[go]
        if not len(live):
            break
        lo[live], hi[live] = np.where(up, lo[live], at), np.where(up, at, hi[live])
        s[live] = np.where(up, (lo[live] + at) / 2, np.where(np.isinf(hi[live]), at * 2, (at + hi[live]) / 2))
    return rho, best


def tsne_transform(start: np.ndarray, p: np.ndarray, near: np.ndarray, rest: np.ndarray, weight: float = 1.0, n_iter: int = 250, early_iter: int = 0, early_exaggeration: float = 4.0, exaggeration: float = 1.5, learning_rate: float = 0.1, momentum: tuple[float, float] = (0.8, 0.8), max_grad_norm: float = 0.25, max_step_norm: float = np.inf) -> np.ndarray:
    """New rows moved among fixed reference rows. Each row's path depends on nothing but its own neighbours, so any
    batching gives the same result. ``near``: the positions of a row's neighbours; ``rest``: those that repel it, each counted
    ``weight`` times."""
    y, step, gains = start.astype(float).copy(), np.zeros_like(start, float), np.ones_like(start, float)
    for it in range(early_iter + n_iter):
        ex, m = (early_exaggeration, momentum[0]) if it < early_iter else (exaggeration, momentum[1])
        diff = y[:, None] - near
        q = 1 / (1 + (diff * diff).sum(2))
        pull = ((ex * p * q)[:, :, None] * diff).sum(1)
        far = y[:, None] - rest[None]
        q = 1 / (1 + (far * far).sum(2))
        push = weight * ((q * q)[:, :, None] * far).sum(1) / np.maximum(weight * q.sum(1), 1e-12)[:, None]
        grad = pull - push
        norm = np.sqrt((grad * grad).sum(1, keepdims=True))
        grad *= np.minimum(1.0, max_grad_norm / np.maximum(norm, 1e-12))
        flip = np.sign(grad) != np.sign(step)
        gains = np.maximum(np.where(flip, gains + 0.2, gains * 0.8 + 0.01), 0.01)
        step = m * step - learning_rate * gains * grad
        if np.isfinite(max_step_norm):
            norm = np.sqrt((step * step).sum(1, keepdims=True))
            step *= np.minimum(1.0, max_step_norm / np.maximum(norm, 1e-12))
        y += step
    return y
