"""Small-matrix kernels shared by the discovery methods: each takes one unit's standardised lag matrix or its moments."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def lag_matrix(x: np.ndarray, tau: int) -> np.ndarray:
    """Rows t >= tau of [x_t, x_{t-1}, ..., x_{t-tau}]; rows with a missing value go. Column lag * N + variable."""
    rows = np.hstack([x[tau - k : len(x) - k] for k in range(tau + 1)])
    return rows[np.isfinite(rows).all(1)]


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_p(r: float, df: float) -> float:
    """Two-sided p-value of a (partial) correlation."""
    if df < 1 or not math.isfinite(r):
        return 1.0
    r = min(abs(r), 1 - 1e-15)
    t2 = r * r * df / (1 - r * r)
    return beta_inc(df / 2, 0.5, df / (df + t2))


def f_p(f: float, d1: float, d2: float) -> float:
    return 1.0 if not math.isfinite(f) or f <= 0 or d2 <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def bh(p: np.ndarray) -> np.ndarray:
    n = len(p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(q, 1)
    return np.maximum(out, p)


def normal_scores(x: np.ndarray) -> np.ndarray:
    """Each column's ranks as normal quantiles."""
    n = len(x)
    table = np.array([NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)])
    return np.column_stack([table[np.argsort(np.argsort(c, kind="stable"), kind="stable")] for c in x.T])


class ParCorr:
    """Partial correlation tests off one correlation matrix of the lag embedding."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.c = len(rows), np.corrcoef(rows, rowvar=False)
        self.c = np.where(np.isfinite(self.c), self.c, 0.0)
        np.fill_diagonal(self.c, 1.0)

    def test(self, x: int, y: int, z: list[int]) -> tuple[float, float]:
        """(partial correlation, p)."""
        i = [x, y, *z]
        p = np.linalg.pinv(self.c[np.ix_(i, i)])
        den = p[0, 0] * p[1, 1]
        r = -p[0, 1] / math.sqrt(den) if den > 0 else 0.0
        return r, t_p(r, self.n - len(z) - 2)


def digamma(n: np.ndarray) -> np.ndarray:
    """At positive integers."""
    top = int(np.max(n))
    table = np.concatenate([[np.nan], -0.5772156649015329 + np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(2, top)))])])
    return table[n.astype(int)]


class CMIKnn:
    """Conditional mutual information by nearest neighbours, with local permutation; distances in row blocks."""

    def __init__(self, rows: np.ndarray, k: float = 0.2, surrogates: int = 100, seed: int = 0) -> None:
        self.rows = np.column_stack([np.argsort(np.argsort(c, kind="stable"), kind="stable") / len(c) for c in rows.T])
        self.n, self.surrogates, self.rng = len(rows), surrogates, np.random.default_rng(seed)
        self.k = max(2, int(k * self.n) if k < 1 else int(k))

    def value(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
        n, total = self.n, 0.0
        for lo in range(0, n, 256):
            dx, dy = np.abs(x[lo : lo + 256, None] - x), np.abs(y[lo : lo + 256, None] - y)
            dz = np.max(np.abs(z[lo : lo + 256, None, :] - z), axis=2) if z.shape[1] else np.zeros_like(dx)
            d = np.maximum(np.maximum(dx, dy), dz)
            eps = np.partition(d, self.k, axis=1)[:, self.k][:, None]
            inside = lambda m, eps=eps: np.maximum((m < eps).sum(1), 1)
            nz = inside(dz) if z.shape[1] else np.full(len(dx), n)
            total += (digamma(nz) - digamma(inside(np.maximum(dx, dz))) - digamma(inside(np.maximum(dy, dz)))).sum()
        return float(digamma(np.array([self.k]))[0] + total / n)

    def shuffled(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """x permuted among rows of like z."""
        if not z.shape[1]:
            return self.rng.permutation(x)
        used, out = np.zeros(self.n, bool), np.empty(self.n)
        near = np.argsort(np.max(np.abs(z[:, None, :] - z), axis=2), axis=1)[:, :5] if self.n <= 2000 else np.array([np.argsort(np.max(np.abs(z - r), axis=1))[:5] for r in z])
        for i in self.rng.permutation(self.n):
            options = self.rng.permutation(near[i])
            j = next((o for o in options if not used[o]), options[0])
            used[j], out[i] = True, x[j]
        return out

    def test(self, x: int, y: int, z: list[int]) -> tuple[float, float]:
        a, b, c = self.rows[:, x], self.rows[:, y], self.rows[:, z]
        seen = self.value(a, b, c)
        worse = sum(self.value(self.shuffled(a, c), b, c) >= seen for _ in range(self.surrogates))
        return seen, (1 + worse) / (1 + self.surrogates)


class GPDC:
    """Distance correlation of Gaussian-process residuals, with permutation. All rows count; the kernel matrix has their
    number squared, so a series of over ``MOST`` rows is refused."""

    MOST = 10_000

    def __init__(self, rows: np.ndarray, surrogates: int = 100, seed: int = 0) -> None:
        if len(rows) > self.MOST:
            raise ValueError(f"gpdc takes series of up to {self.MOST} rows, this one has {len(rows)}; use cmiknn or robust_parcorr")
        self.rows, self.surrogates, self.rng = (rows - rows.mean(0)) / np.maximum(rows.std(0), 1e-12), surrogates, np.random.default_rng(seed)

    def residual(self, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        if not z.shape[1]:
            return y
        k = np.zeros((len(y), len(y)))
        for column in z.T:
            k += (column[:, None] - column) ** 2
        k = np.exp(-0.5 * k / z.shape[1])
        return y - k @ np.linalg.solve(k + 0.5 * np.eye(len(y)), y)

    def test(self, x: int, y: int, z: list[int]) -> tuple[float, float]:
        from .correlation import distance_correlation

        c = self.rows[:, z]
        a, b = self.residual(self.rows[:, x], c), self.residual(self.rows[:, y], c)
        seen = distance_correlation(a, b)[0]
        worse = sum(distance_correlation(self.rng.permutation(a), b)[0] >= seen for _ in range(self.surrogates))
        return seen, (1 + worse) / (1 + self.surrogates)


def make_test(name: str, rows: np.ndarray, **options):
    """A test object with test(x, y, z) -> (value, p)."""
    if name == "robust_parcorr":
        return ParCorr(normal_scores(rows))
    if name == "cmiknn":
        return CMIKnn(rows, **options)
    if name == "gpdc":
        return GPDC(rows, **options)
    return ParCorr(rows)


def lagged_parents(test, n: int, tau: int, alpha: float) -> list[dict[int, float]]:
    """The PC stage for each target: lagged columns that stay when the strongest others are given, with their least |value|."""
    out = []
    for j in range(n):
        strong = {i + n * k: math.inf for k in range(1, tau + 1) for i in range(n)}
        order, size = list(strong), 0
        while order and size <= len(order) - 1:
            drop = []
            for c in order:
                given = [o for o in order if o != c][:size]
                if len(given) < size:
                    continue
                v, p = test.test(c, j, given)
                strong[c] = min(strong[c], abs(v))
                if p > alpha:
                    drop.append(c)
            order = sorted((c for c in order if c not in drop), key=lambda c: -strong[c])
            size += 1
        out.append({c: strong[c] for c in order})
    return out


def pcmci(x: np.ndarray, tau: int, alpha: float = 0.05, contemporaneous: bool = True, test_name: str = "parcorr", q_level: float | None = None, **options) -> list[tuple]:
    """(source, target, lag, value, p, q, directed) of all tested links of one unit; x is rows by variables.

    Lagged links are tested given the parents of both ends (the source's shifted by the lag); links at lag 0, with
    ``contemporaneous``, first lose those that become independent given neighbours at lag 0. Lag-0 links stay undirected."""
    n = x.shape[1]
    rows = lag_matrix(x, 2 * tau)
    if len(rows) < 2 * n + 10:
        return []
    test = make_test(test_name, rows, **options)
    parents = lagged_parents(test, n, tau, alpha)
    shifted = lambda i, k: [c + n * k for c in parents[i] if c + n * k < rows.shape[1]]
    out, near = [], {j: {i for i in range(n) if i != j} for j in range(n)}
    worst: dict[tuple[int, int], tuple[float, float]] = {}
    if contemporaneous:
        from itertools import combinations

        for size in range(n - 1):
            for i in range(n):
                for j in range(i + 1, n):
                    if j in near[i]:
                        for s in combinations(sorted(near[i] - {j}), size):
                            v, p = test.test(i, j, [*s, *parents[j], *[c for c in parents[i] if c not in parents[j]]])
                            if p >= worst.get((i, j), (0, -1.0))[1]:
                                worst[i, j] = (v, p)
                            if p > alpha:
                                near[i].discard(j)
                                near[j].discard(i)
                                break
        out += [(i, j, 0, v, p, False) for (i, j), (v, p) in worst.items()]
    for j in range(n):
        given_now = sorted(near[j]) if contemporaneous else []
        for k in range(1, tau + 1):
            for i in range(n):
                c = i + n * k
                z = list(dict.fromkeys([*[p for p in parents[j] if p != c], *shifted(i, k)]))
                v, p = test.test(c, j, [a for a in z if a not in (c, j)])
                if given_now and p <= alpha:
                    v2, p2 = test.test(c, j, list(dict.fromkeys([*[a for a in z if a not in (c, j)], *given_now])))
                    if p2 > p:
                        v, p = v2, p2
                out.append((i, j, k, v, p, True))
    q = bh(np.array([o[4] for o in out]))
    return [(i, j, k, v, p, float(b), d) for (i, j, k, v, p, d), b in zip(out, q)]


def lpcmci(x: np.ndarray, tau: int, alpha: float = 0.05, test_name: str = "parcorr", **options) -> list[tuple]:
    """(source, target, lag, value, p, mark): links that survive when latent causes are allowed. The skeleton is that of
    ``pcmci``; a lagged link is --> only if removing the source's own past from the condition keeps it (its past acts as
    an instrument), else o->; links at lag 0 are o-o."""
    n, found = x.shape[1], pcmci(x, tau, alpha, True, test_name, **options)
    rows = lag_matrix(x, 2 * tau)
    out = []
    if found:
        test = make_test(test_name, rows, **options)
        for i, j, k, v, p, q, _ in found:
            if q < alpha:
                if k == 0:
                    out.append((i, j, 0, v, p, "o-o"))
                else:
                    past = i + n * (k + 1)
                    blocked = past < rows.shape[1] and test.test(past, j, [i + n * k])[1] > alpha and test.test(past, j, [])[1] <= alpha
                    out.append((i, j, k, v, p, "-->" if blocked or i == j else "o->"))
    return out


def direct_lingam(e: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(causal order, B0) of residuals e (rows by variables): repeatedly take the variable most independent of the others'
    residuals, by differences of approximate entropies."""
    n = e.shape[1]
    z = (e - e.mean(0)) / np.maximum(e.std(0), 1e-12)

    def entropy(u: np.ndarray) -> float:
        return 0.5 * (1 + math.log(2 * math.pi)) - 79.047 * (np.log(np.cosh(u)).mean() - 0.37457) ** 2 - 7.4129 * (u * np.exp(-u * u / 2)).mean() ** 2

    order, rest, w = [], list(range(n)), z.copy()
    while rest:
        score = {}
        for i in rest:
            bad = 0.0
            for j in rest:
                if i != j:
                    xi, xj = (w[:, k] / max(w[:, k].std(), 1e-12) for k in (i, j))
                    r = float((xi * xj).mean())
                    ri, rj = xi - r * xj, xj - r * xi
                    s = max(math.sqrt(max(1 - r * r, 1e-12)), 1e-6)
                    bad += min(0.0, (entropy(xj) + entropy(ri / s)) - (entropy(xi) + entropy(rj / s))) ** 2
            score[i] = bad
        first = min(rest, key=lambda i: (score[i], i))
        order.append(first)
        rest.remove(first)
        for j in rest:
            v = w[:, first]
            w[:, j] = w[:, j] - (w[:, j] * v).mean() / max((v * v).mean(), 1e-12) * v
    b = np.zeros((n, n))
    for k, i in enumerate(order):
        if k:
            b[i, order[:k]] = np.linalg.lstsq(e[:, order[:k]] - e[:, order[:k]].mean(0), e[:, i] - e[:, i].mean(), rcond=None)[0]
    return order, b


def prune(b: np.ndarray, e: np.ndarray, order: list[int]) -> np.ndarray:
    """Drop coefficients whose t-test over the full regression on predecessors fails at 1 %."""
    out = b.copy()
    for k, i in enumerate(order):
        if k:
            x = e[:, order[:k]] - e[:, order[:k]].mean(0)
            res = e[:, i] - e[:, i].mean() - x @ b[i, order[:k]]
            se = np.sqrt(res.var() * np.diag(np.linalg.pinv(x.T @ x)))
            for c, s in zip(order[:k], se):
                if abs(b[i, c]) < 2.576 * s:
                    out[i, c] = 0
    return out


def var_lingam(x: np.ndarray, lags: int, pruned: bool = True) -> list[np.ndarray]:
    """[B_0, ..., B_lags]: B_k[i, j] is the effect of j, k rows earlier, on i. Order by BIC up to ``lags``."""
    n = x.shape[1]
    rows = lag_matrix(x - np.nanmean(x, 0), lags)
    if len(rows) < n * (lags + 1) + 10:
        return []
    best = None
    for p in range(1, lags + 1):
        past = rows[:, n : n * (p + 1)]
        coef, *_ = np.linalg.lstsq(past, rows[:, :n], rcond=None)
        e = rows[:, :n] - past @ coef
        bic = math.log(max(np.linalg.det(e.T @ e / len(e)), 1e-300)) + p * n * n * math.log(len(e)) / len(e)
        if best is None or bic < best[0]:
            best = (bic, p, coef, e)
    _, p, coef, e = best
    order, b0 = direct_lingam(e)
    if pruned:
        b0 = prune(b0, e, order)
    return [b0, *[(np.eye(n) - b0) @ coef[n * k : n * (k + 1)].T for k in range(p)]]


def iaaft(x: np.ndarray, rng: np.random.Generator, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Surrogate with the values of x and nearly its spectrum; the last step puts the values back."""
    values, amplitude, y, last = np.sort(x), np.abs(np.fft.rfft(x)), rng.permutation(x), math.inf
    for _ in range(rounds):
        f = np.fft.rfft(y)
        s = np.fft.irfft(amplitude * np.exp(1j * np.angle(f)), len(x))
        y = values[np.argsort(np.argsort(s, kind="stable"), kind="stable")]
        gap = float(((np.abs(np.fft.rfft(y)) - amplitude) ** 2).mean() / max((amplitude**2).mean(), 1e-300))
        if abs(last - gap) < tolerance:
            break
        last = gap
    return y


def phase(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    f = np.fft.rfft(x)
    turn = np.exp(2j * np.pi * rng.random(len(f)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(f * turn, len(x))


def blocks(x: np.ndarray, rng: np.random.Generator, size: int | None = None) -> np.ndarray:
    n = len(x)
    size = max(1, min(size or int(math.sqrt(n)), n // 2 or 1))
    parts = [x[k : k + size] for k in range(0, n, size)]
    return np.concatenate([parts[i] for i in rng.permutation(len(parts))])


def granger_f(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[float, float]:
    """(F, p) of x's lags in the regression of y on its own: nested least squares."""
    rows = lag_matrix(np.column_stack([x, y]), lag)
    n = len(rows)
    if n < 3 * lag + 5:
        return float("nan"), 1.0
    y0, own, both = rows[:, 1], rows[:, 3::2], rows[:, 2:]
    rss = lambda m: float(((y0 - (d := np.column_stack([np.ones(n), m])) @ np.linalg.lstsq(d, y0, rcond=None)[0]) ** 2).sum())
    r0, r1 = rss(own), rss(both)
    df = n - 2 * lag - 1
    f = (r0 - r1) / lag / max(r1 / df, 1e-300)
    return f, f_p(f, lag, df)
