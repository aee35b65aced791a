"""Small model fits on aggregated figures: they see tens of numbers, so they run in numpy on the driver."""

from __future__ import annotations

import math

import numpy as np


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int, alternative: str = "greater") -> float:
    """Exact test of the table [[a, b], [c, d]]."""
    row, col, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - total), min(row, col)
    logp = {k: log_choose(col, k) + log_choose(total - col, row - k) - log_choose(total, row) for k in range(lo, hi + 1)}
    if alternative == "greater":
        keep = range(a, hi + 1)
    elif alternative == "less":
        keep = range(lo, a + 1)
    else:
        keep = [k for k in logp if logp[k] <= logp[a] + 1e-7]
    return min(1.0, sum(math.exp(logp[k]) for k in keep))


def benjamini_hochberg(p: list[float]) -> list[float]:
    order = sorted(range(len(p)), key=lambda i: p[i], reverse=True)
    out, low = [0.0] * len(p), 1.0
    for k, i in enumerate(order):
        low = min(low, p[i] * len(p) / (len(p) - k))
        out[i] = low
    return out


def nelder_mead(f, start: np.ndarray, rounds: int = 4000, tolerance: float = 1e-10) -> np.ndarray:
    """Downhill simplex with the usual coefficients."""
    pts = [np.array(start, float)]
    for i in range(len(start)):
        p = np.array(start, float)
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        pts.append(p)
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tolerance * (abs(val[0]) + tolerance):
            break
        mid = np.mean(pts[:-1], axis=0)
        for scale, want in ((1.0, "reflect"), (2.0, "expand"), (-0.5, "inside"), (0.5, "outside")):
            if want == "reflect":
                r, fr = mid + (mid - pts[-1]), 0.0
                fr = f(r)
                if val[0] <= fr < val[-2]:
                    pts[-1], val[-1] = r, fr
                    break
            elif want == "expand" and fr < val[0]:
                e = mid + scale * (mid - pts[-1])
                fe = f(e)
                pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
                break
            elif want in ("inside", "outside") and fr >= val[-2]:
                if (want == "inside") != (fr >= val[-1]):
                    continue
                c = mid + scale * (mid - pts[-1])
                fc = f(c)
                if fc < min(fr, val[-1]):
                    pts[-1], val[-1] = c, fc
                    break
        else:
            pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
            val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def binomial_mixture(histogram: list[int], components: int, core_detection: float = 1.0) -> dict[str, float]:
    """Zero-truncated binomial mixture over occupancies 1..n: log-likelihood, BIC, core and pan size.

    One component is the core with a fixed detection probability; the others have free probabilities and weights.
    """
    n, y = len(histogram), np.array(histogram, float)
    g = np.arange(0, n + 1)
    choose = np.array([math.exp(log_choose(n, k)) for k in g])

    def split(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        detect = np.append(1 / (1 + np.exp(-theta[: components - 1])), core_detection)
        mix = np.exp(np.append(theta[components - 1 :], 0.0) - max(0.0, theta[components - 1 :].max(initial=0.0)))
        return detect, mix / mix.sum()

    def density(theta: np.ndarray) -> np.ndarray:
        detect, mix = split(theta)
        with np.errstate(divide="ignore", invalid="ignore"):
            return sum(m * choose * d**g * (1 - d) ** (n - g) for m, d in zip(mix, detect, strict=True))

    def loss(theta: np.ndarray) -> float:
        p = density(theta)
        if not np.isfinite(p).all() or p[0] >= 1:
            return 1e12
        return -float((y * np.log(np.maximum(p[1:], 1e-300) / (1 - p[0]))).sum())

    start = np.concatenate((np.linspace(-3, 1.5, components - 1), np.zeros(components - 1)))
    best = start
    for _ in range(4):
        best = nelder_mead(loss, best)
    p, (_, mix), ll = density(best), split(best), -loss(best)
    pan = y.sum() / (1 - p[0])
    return {"components": components, "log_likelihood": ll, "bic": -2 * ll + math.log(y.sum()) * (2 * components - 1), "core": round(pan * mix[-1]), "pan": round(pan)}


def binomial_mixtures(histogram: list[int], core_detection: float = 1.0) -> list[dict[str, float]]:
    """Mixtures of 2 to min(n, 10) components, each marked with whether its BIC is the least of them (the first on ties)."""
    fits = [binomial_mixture(histogram, k, core_detection) for k in range(2, max(2, min(len(histogram), 10)) + 1)]
    best = min(fits, key=lambda f: f["bic"])
    return [f | {"chosen": float(f is best)} for f in fits]


def gauss_newton(f, x: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Least squares with a damped Gauss-Newton step; returns the parameters and the residual standard error."""
    p, lam = np.array(start, float), 1e-3
    err = y - f(x, p)
    for _ in range(rounds):
        jac = np.stack([(f(x, p + h) - f(x, p - h)) / (2 * h[i]) for i in range(len(p)) for h in [np.eye(len(p))[i] * max(1e-6, abs(p[i]) * 1e-6)]], axis=1)
        a = jac.T @ jac
        step = np.linalg.lstsq(a + lam * np.diag(np.diag(a) + 1e-12), jac.T @ err, rcond=None)[0]
        new = y - f(x, p + step)
        if np.isfinite(new).all() and new @ new <= err @ err:
            done = err @ err - new @ new <= 1e-12 * (err @ err + 1e-30)
            p, err, lam = p + step, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return p, math.sqrt(float(err @ err) / max(1, len(y) - len(p)))


def core_tettelin(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] + p[1] * np.exp(-g / p[2])


def core_willenbrock(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] + p[1] * np.exp(-(g**0.25) / p[2])


def pan_tettelin(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    omega, theta, k, tau = p
    return omega + theta * (g - 1) + k * np.exp(-2 / tau) * (1 - np.exp(-(g - 1) / tau)) / (1 - np.exp(-1 / tau))


def fit_core(g, n, willenbrock: bool = False) -> dict[str, float]:
    """Starts of tau from 2.8 downwards in steps of 0.2; the first that converges to a finite fit wins."""
    f, g, n = core_willenbrock if willenbrock else core_tettelin, np.asarray(g, float), np.asarray(n, float)
    for tau in np.arange(2.8, 0.1, -0.2):
        p, se = gauss_newton(f, g, n, [n.min(), max(n.max() - n.min(), 1), tau])
        if np.isfinite(p).all() and p[2] > 0:
            return {"omega": p[0], "k": p[1], "tau": p[2], "residual": se}
    raise ValueError("no fit")


def fit_pan(g, n) -> dict[str, float]:
    p, se = gauss_newton(pan_tettelin, np.asarray(g, float), np.asarray(n, float), [np.asarray(n, float).min(), 33.0, 476.0, 2.5])
    return {"omega": p[0], "theta": p[1], "k": p[2], "tau": p[3], "residual": se}


def linkage(names: list[str], distance: np.ndarray, method: str = "average") -> str:
    """Agglomerative clustering by Lance-Williams updates; the tree as Newick with branch lengths."""
    d = distance.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    node, size, height = list(names), [1] * len(names), [0.0] * len(names)
    alive = list(range(len(names)))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = alive[min(i, j)], alive[max(i, j)]
        h = (math.sqrt(d[a, b]) if method == "ward" else d[a, b]) / 2
        for k in alive:
            if k in (a, b):
                continue
            na, nb, nk = size[a], size[b], size[k]
            if method == "average":
                v = (na * d[a, k] + nb * d[b, k]) / (na + nb)
            elif method == "complete":
                v = max(d[a, k], d[b, k])
            elif method == "single":
                v = min(d[a, k], d[b, k])
            else:
                v = ((na + nk) * d[a, k] + (nb + nk) * d[b, k] - nk * d[a, b]) / (na + nb + nk)
            d[a, k] = d[k, a] = v
        node[a] = f"({node[a]}:{h - height[a]:.6g},{node[b]}:{h - height[b]:.6g})"
        size[a], height[a] = size[a] + size[b], h
        alive.remove(b)
    return node[alive[0]] + ";"


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette width of a labelling; clusters of one count as 0."""
    out = []
    for i in range(len(label)):
        own = label == label[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = distance[i, own].sum() / (own.sum() - 1)
        b = min((distance[i, label == k].mean() for k in set(label) - {label[i]}), default=0.0)
        out.append((b - a) / max(a, b, 1e-300))
    return float(np.mean(out))


def bionj(names: list[str], distance: np.ndarray) -> str:
    """Neighbour joining with variance weights, an unrooted tree as Newick; negative branches are kept as they come.

    The pair with the least corrected distance joins; distances to the new node weigh its two sides so that their
    variance (taken as proportional to the distance itself) is least.
    """
    d = np.array(distance, float)
    v, node = d.copy(), list(names)
    while len(node) > 3:
        m = len(node)
        total = d.sum(axis=1)
        score = (m - 2) * d - total[:, None] - total[None]
        np.fill_diagonal(score, np.inf)
        i, j = sorted(map(int, np.unravel_index(np.argmin(score), score.shape)))
        left = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        right = d[i, j] - left
        rest = [k for k in range(m) if k not in (i, j)]
        share = 0.5 if v[i, j] == 0 else float(np.clip(0.5 + (v[j, rest] - v[i, rest]).sum() / (2 * (m - 2) * v[i, j]), 0, 1))
        new_d = share * (d[i, rest] - left) + (1 - share) * (d[j, rest] - right)
        new_v = share * v[i, rest] + (1 - share) * v[j, rest] - share * (1 - share) * v[i, j]
        joined = f"({node[i]}:{left:.6g},{node[j]}:{right:.6g})"
        d, v = (np.vstack((np.column_stack((a[np.ix_(rest, rest)], b)), np.append(b, 0.0))) for a, b in ((d, new_d), (v, new_v)))
        node = [node[k] for k in rest] + [joined]
    if len(node) < 3:
        return f"({','.join(f'{n}:{d[0, -1] / 2:.6g}' for n in node)});"
    ends = [(d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2]
    return "(" + ",".join(f"{n}:{x:.6g}" for n, x in zip(node, ends, strict=True)) + ");"


def gap_statistic(points: np.ndarray, most: int = 8, references: int = 50, seed: int = 0, method: str = "average") -> list[tuple[int, float, float]]:
    """(k, gap, standard error) for k = 1..most clusters of the rows of `points`, cut from their hierarchical tree.

    The gap is how much lower the log of the pooled within-cluster spread is than that of points drawn evenly from the
    box that the points fill. points holds a row a taxon, so the caller brings it to a handful of columns first.
    """
    rng, points = np.random.default_rng(seed), np.asarray(points, float)

    def spread(x: np.ndarray) -> np.ndarray:
        distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        out = []
        for k in range(1, most + 1):
            label = cut_tree(distance, k, method)
            out.append(sum((distance[np.ix_(label == c, label == c)] ** 2).sum() / (2 * (label == c).sum()) for c in np.unique(label)))
        return np.log(np.maximum(out, 1e-300))

    low, high, own = points.min(axis=0), points.max(axis=0), spread(points)
    drawn = np.array([spread(rng.uniform(low, high, points.shape)) for _ in range(references)])
    error = drawn.std(axis=0) * math.sqrt(1 + 1 / references)
    return [(k + 1, float(drawn[:, k].mean() - own[k]), float(error[k])) for k in range(most)]


def cut_tree(distance: np.ndarray, k: int, method: str = "average") -> np.ndarray:
    """Labels of k clusters by agglomeration: average, complete or single linkage."""
    label = np.arange(len(distance))
    pick = {"average": np.mean, "complete": np.max, "single": np.min}[method]
    while len(np.unique(label)) > k:
        kinds = np.unique(label)
        _, a, b = min((pick(distance[np.ix_(label == a, label == b)]), a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :])
        label[label == b] = a
    return label
