"""Small dense solvers on NumPy arrays; no Spark in here.

Elastic net: Friedman, Hastie & Tibshirani (2010).  HDBSCAN: Campello, Moulavi & Sander (2013).  FastICA: Hyvarinen & Oja
(2000).  Parallel analysis: Horn (1965).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FEW = 32  # a smaller stack of problems is solved one by one, which costs less; with several tasks, one of fewer than 4


def soft(x: np.ndarray | float, t: float) -> np.ndarray | float:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def enet_gram(g: np.ndarray, c: np.ndarray, alpha: float, rho: float, max_iter: int = 10_000, tol: float = 1e-10, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Coordinate descent on moments: minimises b'Gb/2 - c'b + alpha rho |b|_1 + alpha (1 - rho) |b|^2 / 2.

    ``c`` of shape (P,) is one task; (P, T) is multi-task, with the penalty on rows' norms and so one shared support.
    ``start`` is where to begin, else zero.  A stack of problems has ``g`` of shape (N, P, P) and ``c`` with N leading; all begin at ``start``.
    """
    if g.ndim == 3:
        return _enet_stack(g, c, alpha, rho, max_iter, tol, start)
    if c.ndim == 1:
        return _enet_one(np.ascontiguousarray(g, dtype=float), c, alpha, rho, max_iter, tol, start)
    p = len(g)
    b = np.zeros_like(c) if start is None else start.reshape(c.shape).astype(float)
    grad = c - g @ b
    l1, den = alpha * rho, np.diag(g) + alpha * (1 - rho)
    active = np.arange(p)
    scale = max(1.0, float(np.abs(c).max(initial=0)))
    for it in range(max_iter):
        full = it % 10 == 0 or len(active) == p
        move = 0.0
        for j in range(p) if full else active:
            old = b[j].copy()
            r = grad[j] + g[j, j] * old
            n = float(np.sqrt(r @ r))
            new = r * (max(0.0, 1 - l1 / n) / den[j]) if n > 0 and den[j] > 0 else np.zeros_like(r)
            d = new - old
            if d.any():
                b[j] = new
                grad -= np.outer(g[:, j], d)
                move = max(move, float(np.abs(d).max()) * max(1e-12, float(g[j, j])))
        if move <= tol * scale:
            if full:
                return b, True
            active = np.arange(p)
        else:
            active = np.flatnonzero(b.any(1))
    return b, False


def _enet_one(g: np.ndarray, c: np.ndarray, alpha: float, rho: float, max_iter: int, tol: float, start: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """Coordinate descent of one task: a coordinate costs a few numbers and, if it moves, one row of ``g``."""
    p = len(g)
    b = [0.0] * p if start is None else [float(x) for x in start]
    grad = c - g @ np.array(b)
    l1, diag = alpha * rho, np.diag(g).tolist()
    den = [x + alpha * (1 - rho) for x in diag]
    active, scale = range(p), max(1.0, float(np.abs(c).max(initial=0)))
    for it in range(max_iter):
        full = it % 10 == 0 or len(active) == p
        move = 0.0
        for j in range(p) if full else active:
            old = b[j]
            r = float(grad[j]) + diag[j] * old
            over = abs(r) - l1
            new = (over if r > 0 else -over) / den[j] if over > 0 and den[j] > 0 else 0.0
            if new != old:
                b[j] = new
                grad -= g[j] * (new - old)
                move = max(move, abs(new - old) * max(1e-12, diag[j]))
        if move <= tol * scale:
            if full:
                return np.array(b), True
            active = range(p)
        else:
            active = [j for j in range(p) if b[j]]
    return np.array(b), False


def _enet_stack(g: np.ndarray, c: np.ndarray, alpha: float, rho: float, max_iter: int, tol: float, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent of a stack of problems, a coordinate of all at once; each has its own active set and ends where it would alone."""
    if len(g) < (FEW if c.ndim == 2 else 4):
        got = [enet_gram(x, y, alpha, rho, max_iter, tol, start) for x, y in zip(g, c, strict=True)]
        return np.array([b for b, _ in got]).reshape(c.shape), np.array([ok for _, ok in got], dtype=bool)
    shape, c = c.shape, c if c.ndim == 3 else c[:, :, None]
    out = np.zeros(c.shape) if start is None else np.broadcast_to(start.reshape(c.shape[1:]), c.shape).astype(float)
    found, left = np.zeros(len(g), dtype=bool), np.arange(len(g))
    b, grad, l1, diag = out.copy(), c - g @ out, alpha * rho, np.diagonal(g, axis1=1, axis2=2)
    active, scale = np.ones(c.shape[:2], dtype=bool), np.maximum(1.0, np.abs(c).max((1, 2), initial=0))
    for it in range(max_iter):
        full = active.all(1) | (it % 10 == 0)
        move = np.zeros(len(left))
        for j in range(c.shape[1]):
            mine = full | active[:, j]
            if not mine.any():
                continue
            old = b[:, j].copy()
            r = grad[:, j] + diag[:, j, None] * old
            n, den = np.sqrt((r * r).sum(1)), diag[:, j] + alpha * (1 - rho)
            on = (n > l1) & (den > 0)
            by = np.where(on, n - l1, 0) / np.where(on, den, 1)
            new = np.where(mine[:, None], r / np.where(on, n, 1)[:, None] * by[:, None], old)
            d = new - old
            if d.any():
                b[:, j] = new
                grad -= g[:, :, j, None] * d[:, None]
                move = np.maximum(move, np.abs(d).max(1) * np.maximum(1e-12, diag[:, j]))
        still = move <= tol * scale
        done = still & full
        active = b.any(2) | still[:, None]
        if done.any():
            out[left[done]], found[left[done]] = b[done], True
            left, b, grad, g, diag, active, scale = (x[~done] for x in (left, b, grad, g, diag, active, scale))
            if not len(left):
                break
    out[left] = b
    return out.reshape(shape), found


def kkt_residual(g: np.ndarray, c: np.ndarray, b: np.ndarray, alpha: float, rho: float) -> float:
    """How far ``b`` (single task) is from the optimality conditions."""
    r = c - g @ b - alpha * (1 - rho) * b
    return float(np.max(np.where(b != 0, np.abs(r - alpha * rho * np.sign(b)), np.maximum(np.abs(r) - alpha * rho, 0)), initial=0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logistic_enet(x: np.ndarray, y: np.ndarray, k: int, c: float, rho: float, w: np.ndarray | None = None, max_iter: int = 5000, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, bool]:
    """Elastic-net logistic regression: C sum w loss + rho |b|_1 + (1 - rho) |b|^2 / 2, intercept free.

    ``y`` holds class numbers below k.  k = 2 is one logistic model (1, P), more is one multinomial model (K, P).
    Accelerated proximal gradient with restarts; returns coefficients, intercepts, convergence.
    """
    n, p = x.shape
    w = np.ones(n) if w is None else w
    m = 1 if k == 2 else k
    t = (y == 1).astype(float)[:, None] if m == 1 else np.eye(k)[y]
    xa = np.column_stack([x, np.ones(n)])
    top = float(np.linalg.norm(xa * np.sqrt(w)[:, None], 2) ** 2)
    step = 1 / (c * top * (0.25 if m == 1 else 0.5) + (1 - rho))
    b = np.zeros((m, p + 1))
    v, s, done = b.copy(), 1.0, False
    for _ in range(max_iter):
        z = xa @ v.T
        q = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if m == 1 else softmax(z)
        g = c * ((q - t) * w[:, None]).T @ xa
        g[:, :p] += (1 - rho) * v[:, :p]
        new = v - step * g
        new[:, :p] = soft(new[:, :p], rho * step)
        d = new - b
        if float(np.abs(d).max()) <= tol * max(1.0, float(np.abs(new).max())):
            b, done = new, True
            break
        if float(((v - new) * d).sum()) > 0:
            s = 1.0
        s2 = (1 + np.sqrt(1 + 4 * s * s)) / 2
        v, b, s = new + (s - 1) / s2 * d, new, s2
    return b[:, :p], b[:, p], done


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (P, ...) and intercept of least squares."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b[1:], b[0]


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd (ddof 0) of columns; a constant column has scale 1."""
    m, s = x.mean(0), x.std(0)
    return m, np.where(s > 10 * np.finfo(float).eps * np.maximum(np.abs(m), 1e-300), s, 1.0)


def first_component(x: np.ndarray) -> np.ndarray:
    """The first principal axis of standardised columns, its largest loading positive."""
    z = (x - scaler(x)[0]) / scaler(x)[1]
    if z.shape[1] <= z.shape[0]:
        return leading_axis(z.T @ z)
    v = z.T @ np.linalg.eigh(z @ z.T)[1][:, -1]
    return _signed(v / (np.linalg.norm(v) or 1.0))


def leading_axis(r: np.ndarray) -> np.ndarray:
    """The first eigenvector of correlations, its largest loading positive."""
    return _signed(np.linalg.eigh(r)[1][:, -1])


def _signed(v: np.ndarray) -> np.ndarray:
    """Of loadings as large as the largest, but for rounding, the first is positive."""
    size = np.abs(v)
    return v * np.sign(v[np.argmax(size >= size.max() * (1 - 1e-9))] or 1.0)


def distance_matrix(x: np.ndarray, metric: str = "spearman", signed: bool = False) -> np.ndarray:
    """Correlation distances of columns."""
    if x.shape[1] == 1:
        return np.zeros((1, 1))
    if metric == "spearman":
        x = np.column_stack([rank_average(c) for c in x.T])
    z = x - x.mean(0)
    s = np.sqrt((z * z).sum(0))
    with np.errstate(all="ignore"):
        r = np.nan_to_num((z.T @ z) / np.outer(s, s))
    return correlation_distance(r, signed)


def correlation_distance(r: np.ndarray, signed: bool = False) -> np.ndarray:
    if len(r) == 1:
        return np.zeros((1, 1))
    d = np.sqrt(np.clip(2 * (1 - (r if signed else np.abs(r))), 0, 4))
    np.fill_diagonal(d, 0)
    return (d + d.T) / 2


def rank_average(v: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    n = np.diff(np.append(first, len(s)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (n + 1) / 2, n)
    return out


def hdbscan(d: np.ndarray, min_size: int) -> np.ndarray:
    """Labels from 0, noise -1: mutual reachability, minimum spanning tree, condensed tree, excess of mass."""
    n = len(d)
    if n < 2 or n < min_size:
        return np.full(n, -1)
    core = np.sort(d, axis=1)[:, min(min_size, n) - 1]  # a point is its own first neighbour
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, link, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], link[closer] = reach[at][closer], at
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    edges.sort(key=lambda e: e[0])
    # Single-linkage tree: node n + i joins two nodes.
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}
    top = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (w, a, b) in enumerate(edges):
        ra, rb = find(a), find(b)
        new = n + i
        kids[new] = (top[ra] if ra < n else ra, top[rb] if rb < n else rb, float(w))
        parent[ra] = parent[rb] = new
        size[new] = size[ra] + size[rb]

    def leaves(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += kids[y][:2]
        return out

    lam = lambda w: 1 / w if w > 0 else np.inf
    clusters: list[dict] = [{"birth": 0.0, "stability": 0.0, "kids": [], "points": [], "parent": -1}]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        a, b, w = kids[node]
        l_ = lam(w)
        gain = lambda k: k * (min(l_, 1e300) - clusters[c]["birth"])  # noqa: B023,E731
        big = [x for x in (a, b) if size[x] >= min_size]
        if len(big) == 2:
            clusters[c]["stability"] += gain(size[node])
            for x in (a, b):
                clusters.append({"birth": min(l_, 1e300), "stability": 0.0, "kids": [], "points": [], "parent": c})
                clusters[c]["kids"].append(len(clusters) - 1)
                stack.append((x, len(clusters) - 1))
        else:
            for x in (a, b):
                if x in big:
                    stack.append((x, c))
                else:
                    pts = leaves(x)
                    clusters[c]["points"] += pts
                    clusters[c]["stability"] += gain(len(pts))
    chosen = [False] * len(clusters)
    total = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(total[k] for k in clusters[c]["kids"])
        if c and clusters[c]["stability"] >= below:
            chosen[c], total[c] = True, clusters[c]["stability"]
        else:
            total[c] = below
    labels, number = np.full(n, -1), 0
    stack = [0]
    picked = []
    while stack:
        c = stack.pop()
        if chosen[c]:
            picked.append(c)
        else:
            stack += clusters[c]["kids"]
    for c in sorted(picked):
        members, todo = [], [c]
        while todo:
            x = todo.pop()
            members += clusters[x]["points"]
            todo += clusters[x]["kids"]
        labels[members] = number
        number += 1
    return labels


def parallel_analysis(x: np.ndarray, n_sim: int = 100, level: float = 0.95, seed: int = 42, standardize: bool = False) -> int:
    """Components whose eigenvalue is above the level's percentile of those of normal noise; 1 at least.

    Centring takes a rank away, so an eigenvalue that is rounding noise beside the largest is no component.
    """
    n, p = x.shape
    if p == 1:
        return 1

    def eig(a: np.ndarray) -> np.ndarray:
        z = a - a.mean(0)
        m = z @ z.T if p > n else z.T @ z
        return np.sort(np.linalg.eigvalsh(m / (n - 1)))[::-1]

    obs = eig((x - x.mean(0)) / scaler(x)[1] if standardize else x)
    rng = np.random.RandomState(seed)
    sims = np.array([eig(rng.normal(size=(n, p))) for _ in range(n_sim)])
    real = obs > obs[0] * max(n, p) * np.finfo(float).eps
    return max(1, int((real & (obs > np.percentile(sims, level * 100, axis=0))).sum()))


def fast_ica(x: np.ndarray, k: int, max_iter: int = 1000, tol: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources have unit variance: returns means, unmixing (k, P) and mixing (P, k)."""
    m = x.mean(0)
    z = (x - m).T
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()) or 1)
    white = (u[:, :k] / s[:k]).T * np.sqrt(z.shape[1])
    zw = white @ z
    w = np.random.RandomState(seed).normal(size=(k, k))

    def decorrelate(a: np.ndarray) -> np.ndarray:
        e, v = np.linalg.eigh(a @ a.T)
        return v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-300))) @ v.T @ a

    w = decorrelate(w)
    for _ in range(max_iter):
        g = np.tanh(w @ zw)
        new = decorrelate(g @ zw.T / zw.shape[1] - np.diag((1 - g * g).mean(1)) @ w)
        lim = float(np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1)))
        w = new
        if lim < tol:
            break
    unmix = w @ white
    sd = (unmix @ z).std(1)
    unmix = unmix / np.where(sd > 0, sd, 1.0)[:, None]
    return m, unmix, np.linalg.pinv(unmix)


@dataclass
class Fitted:
    """A fitted linear model on raw columns of the design: scaling, coefficients (T, P) on the scaled ones, intercepts; or a stack of models."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    converged: bool | np.ndarray

    def linear(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.coef.T + self.intercept
