"""Small boosted trees, lasso logistic weights and isotonic calibration on a bounded sample, in numpy."""

from __future__ import annotations

import numpy as np

Tree = dict[str, np.ndarray]  # feature (-1: leaf), cut, left, right, value, by node; left if x <= cut


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Places between neighbouring values, at most bins - 1 a column."""
    out = []
    for col in x.T:
        v = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1), method="lower"))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> Tree:
    """A regression tree on gradients g and curvatures h, level by level, over binned columns."""
    n, m = codes.shape
    bins = max(len(c) for c in cuts) + 1
    node = np.zeros(n, np.int64)
    feature, cut, left, right, value = [-1], [0.0], [0], [0], [0.0]
    level = [0]
    for d in range(depth + 1):
        where = {k: i for i, k in enumerate(level)}
        at = np.full(len(feature), -1)
        at[level] = range(len(level))
        slot = at[node]
        here = np.flatnonzero(slot >= 0)
        gs = np.bincount(slot[here], g[here], len(level))
        hs = np.bincount(slot[here], h[here], len(level))
        for k, i in where.items():
            value[k] = float(gs[i] / (hs[i] + l2))
        if d == depth:
            break
        best = np.full(len(level), 1e-6)
        pick = np.full((len(level), 2), -1)
        for f in range(m):
            if not len(cuts[f]):
                continue
            key = slot[here] * bins + codes[here, f]
            gl = np.bincount(key, g[here], len(level) * bins).reshape(-1, bins).cumsum(axis=1)[:, :-1]
            hl = np.bincount(key, h[here], len(level) * bins).reshape(-1, bins).cumsum(axis=1)[:, :-1]
            gr, hr = gs[:, None] - gl, hs[:, None] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None]
            gain[(hl < least) | (hr < least)] = -1
            b = gain.argmax(axis=1)
            top = gain[np.arange(len(level)), b]
            better = top > best
            best[better], pick[better] = top[better], np.stack([np.full(better.sum(), f), b[better]], axis=1)
        new = []
        for k, i in where.items():
            f, b = pick[i].tolist()
            if f < 0 or b >= len(cuts[f]):
                continue
            feature[k], cut[k], left[k], right[k] = f, float(cuts[f][b]), len(feature), len(feature) + 1
            for _ in range(2):
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                right.append(0)
                value.append(0.0)
            own = node == k
            node[own] = np.where(codes[own, f] <= b, left[k], right[k])
            new += [left[k], right[k]]
        if not new:
            break
        level = new
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "value": np.array(value)}


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        f = tree["feature"][at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return at
        a = at[inner]
        at[inner] = np.where(x[inner, f[inner]] <= tree["cut"][a], tree["left"][a], tree["right"][a])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 2.0, l2: float = 1.0) -> tuple[float, list[Tree]]:
    """Base score and trees of a logistic boosted model; each tree's values include the rate."""
    cuts = _cuts(x, bins)
    codes = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = sigmoid(z)
        t = grow(codes, cuts, y - q, np.maximum(q * (1 - q), 1e-6), depth, least, l2)
        t["value"] = t["value"] * rate
        trees.append(t)
        z += t["value"][leaves(t, x)]
    return base, trees


def margin(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model[0])
    for t in model[1]:
        z += t["value"][leaves(t, x)]
    return z


Rule = tuple[tuple[int, bool, float], ...]  # (feature, at most, cut), ...


def rules_of(trees: list[Tree]) -> list[Rule]:
    """Every path from a root to a node below it; a feature's bounds on a path are merged."""
    out: dict[Rule, None] = {}
    for t in trees:
        stack: list = [(0, {})]
        while stack:
            k, held = stack.pop()
            if held:
                out[tuple((f, le, c) for (f, le), c in sorted(held.items()))] = None
            f = int(t["feature"][k])
            if f >= 0:
                c = float(t["cut"][k])
                stack.append((int(t["left"][k]), held | {(f, True): min(c, held.get((f, True), c))}))
                stack.append((int(t["right"][k]), held | {(f, False): max(c, held.get((f, False), c))}))
    return list(out)


def applies(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for f, le, c in rule:
            out[:, i] *= (x[:, f] <= c) if le else (x[:, f] > c)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250, start: tuple[float, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient; the intercept isn't penalised."""
    n, m = r.shape
    v = np.ones(m, np.float32)
    for _ in range(15):  # the largest eigenvalue of r'r / n bounds the curvature
        v = r.T @ (r @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 4 / (top / n + 1)
    b, w = start or (0.0, np.zeros(m, np.float32))
    b0, w0, t0 = b, w, 1.0
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        bm, wm = b + (t0 - 1) / t1 * (b - b0), w + np.float32((t0 - 1) / t1) * (w - w0)
        b0, w0, t0 = b, w, t1
        e = (sigmoid(r @ wm + bm) - y).astype(np.float32)
        b = float(bm - step * e.mean())
        w = wm - np.float32(step) * (r.T @ e / n)
        w = np.sign(w) * np.maximum(np.abs(w) - np.float32(step * penalty), 0)
    return b, w


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing steps of the mean of y along z (pool adjacent violators): block centres and values."""
    order = np.argsort(z, kind="stable")
    stack: list[list[float]] = []
    for a, b in zip(z[order].tolist(), y[order].tolist(), strict=True):
        stack.append([b, 1.0, a])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            s, n, c = stack.pop()
            stack[-1] = [stack[-1][0] + s, stack[-1][1] + n, stack[-1][2] + c]
    return np.array([c / n for _, n, c in stack]), np.array([s / n for s, n, _ in stack])
