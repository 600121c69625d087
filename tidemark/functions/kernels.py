"""Numerical kernels on NumPy, for grouped maps over one site's series."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def loess(x: np.ndarray, y: np.ndarray, f: float = 0.5, niter: int = 2, d: int = 1, weights: str | Callable = "tricube", equal_spacing: bool | None = None) -> np.ndarray:
    """Locally weighted regression of degree 0 or 1; niter - 1 rounds weigh down outliers. NaN stays NaN."""
    if d not in (0, 1):
        raise ValueError("d is 0 or 1")
    kernel = weights if callable(weights) else {"tricube": lambda u: np.clip(1 - u**3, 0, None) ** 3, "gaussian": lambda u: np.where(u < 1, np.exp(-(u**2) / (2 * (1 / 1.96) ** 2)), 0)}[weights]
    out = np.full(len(y), np.nan)
    if len(x) < 2:
        return y.copy()
    x = (x - x[0]) / (x[-1] - x[0])
    gaps = np.diff(x)
    if equal_spacing is None:
        equal_spacing = bool(np.allclose(gaps, gaps[0]))
    dx = gaps[0]
    known = ~np.isnan(y)
    x, y = x[known], y[known]
    n = len(x)
    if not n:
        return out
    if equal_spacing:
        r = int(2 * (f * n // 2) + 1)
        i, half = np.arange(n), (r - 1) // 2
        reach = np.where(i < half, r - i, np.where(i >= n - half, i - (n - r) + 1, half + 1)) * dx
    else:
        r = min(int(np.round(f * n)), n - 1)
        reach = np.array([np.partition(np.abs(x - c), r)[r] for c in x])
    low, high = np.searchsorted(x, x - reach, "left"), np.searchsorted(x, x + reach, "right")
    trust, fit = np.ones(n), np.empty(n)
    widest = int((high - low).max())
    step = max(1, (1 << 20) // widest)
    for round_ in range(niter):
        # rows of windows side by side, filled up with points of no weight
        for begin in range(0, n, step):
            rows = slice(begin, begin + step)
            at = low[rows, None] + np.arange(widest)
            inside = at < high[rows, None]
            at = np.minimum(at, n - 1)
            xs, ys = x[at], y[at]
            w = np.where(inside, trust[at] * kernel(np.abs(xs - x[rows, None]) / reach[rows, None]), 0.0)
            total = w.sum(axis=1)
            mean = (w * ys).sum(axis=1) / total
            if d == 1:
                off = xs - ((w * xs).sum(axis=1) / total)[:, None]
                spread = (w * off**2).sum(axis=1)
                slope = np.divide((w * off * ys).sum(axis=1), spread, out=np.zeros(len(total)), where=spread > 0)
                mean += slope * (x[rows] - (w * xs).sum(axis=1) / total)
            fit[rows] = mean
        if round_ < niter - 1:
            rest = y - fit
            scale = np.median(np.abs(rest))
            u = rest / (6 * scale) if scale else (rest != 0).astype(float)
            trust = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
    out[known] = fit
    return out


def nelder_mead(f: Callable, start: np.ndarray, rounds: int = 2000, close: float = 1e-9) -> np.ndarray:
    """The downhill simplex method."""
    n = len(start)
    points = np.vstack([start, *(start + np.eye(n)[i] * (0.05 * abs(start[i]) or 0.00025) for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= close and np.abs(points - points[0]).max() <= close:
            break
        centre = points[:-1].mean(axis=0)
        away = centre + (centre - points[-1])
        v = f(away)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            near = centre + 0.5 * ((away if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[np.argmin(values)]


def l_moments(x: np.ndarray) -> tuple[float, float, float]:
    """First two L-moments and the L-skewness."""
    x = np.sort(x)
    n = len(x)
    i = np.arange(n)
    b0, b1 = x.mean(), (i * x).sum() / (n * (n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2))
    l2 = 2 * b1 - b0
    return b0, l2, (6 * b2 - 6 * b1 + b0) / l2


def gpd_cdf(x: np.ndarray, c: float, scale: float, loc: float = 0.0) -> np.ndarray:
    z = np.maximum(x - loc, 0) / scale
    if abs(c) < 1e-12:
        return 1 - np.exp(-z)
    return 1 - np.clip(1 + c * z, 0, None) ** (-1 / c)


def gpd_ppf(p: np.ndarray, c: float, scale: float, loc: float = 0.0) -> np.ndarray:
    p = np.asarray(p, float)
    return loc + scale * (-np.log1p(-p) if abs(c) < 1e-12 else np.expm1(-c * np.log1p(-p)) / c)


def fit_gpd(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of excesses over 0 by maximum likelihood, from their moments."""
    x = x[~np.isnan(x)]
    if len(x) < 2 or x.max() <= 0:
        return math.nan, math.nan
    mean, var = x.mean(), x.var()
    start = np.array([0.5 * (1 - mean**2 / var), 0.5 * mean * (mean**2 / var + 1)]) if var > 0 else np.array([0.1, mean])

    def loss(p: np.ndarray) -> float:
        c, scale = p
        if scale <= 0 or (c < 0 and 1 + c * x.max() / scale <= 0):
            return math.inf
        return len(x) * math.log(scale) + (x.sum() / scale if abs(c) < 1e-9 else (1 + 1 / c) * np.log1p(c * x / scale).sum())

    if not math.isfinite(loss(start)):
        start = np.array([0.1, mean])
    return tuple(nelder_mead(loss, start).tolist())


def fit_gev(x: np.ndarray, method: str = "ML") -> tuple[float, float, float]:
    """Shape (positive: bounded above), location and scale; PWM from L-moments, ML from there by maximum likelihood."""
    x = x[~np.isnan(x)]
    if len(x) < 3:
        return math.nan, math.nan, math.nan
    l1, l2, t3 = l_moments(x)
    if not l2 > 0:
        return math.nan, math.nan, math.nan
    z = 2 / (3 + t3) - math.log(2) / math.log(3)
    c = 7.859 * z + 2.9554 * z**2
    gamma = math.gamma(1 + c)
    scale = l2 * c / (gamma * (1 - 2**-c)) if abs(c) > 1e-9 else l2 / math.log(2)
    loc = l1 - (scale * (1 - gamma) / c if abs(c) > 1e-9 else scale * 0.5772156649015329)
    if method == "PWM":
        return c, loc, scale
    if method != "ML":
        raise ValueError("method is ML or PWM")

    def loss(p: np.ndarray) -> float:
        c, loc, scale = p
        if scale <= 0:
            return math.inf
        u = (x - loc) / scale
        if abs(c) < 1e-9:
            return len(x) * math.log(scale) + (u + np.exp(-u)).sum()
        t = 1 - c * u
        if t.min() <= 0:
            return math.inf
        log = np.log(t)
        return len(x) * math.log(scale) + ((1 - 1 / c) * log + np.exp(log / c)).sum()

    return tuple(nelder_mead(loss, np.array([c, loc, scale])).tolist())


def gev_ppf(p: float, c: float, loc: float, scale: float) -> float:
    y = -math.log(p)
    return loc - scale * math.log(y) if abs(c) < 1e-12 else loc + scale * (1 - y**c) / c


def _low_end(x: np.ndarray) -> float:
    """A location below the least value, from the two least and the greatest."""
    x = np.sort(x)
    first, second, last = x[0], x[1], x[-1]
    bend = first + last - 2 * second
    loc = (first * last - second**2) / bend if bend else first
    return loc if loc < first else first * (0.9999 if first > 0 else 1.0001)


def first_guess(x: np.ndarray, dist: str, loc: float | None = None) -> tuple[float, float, float]:
    """Shape, location and scale to start a fit from. The formulas are fixed: they are also the approximate fit."""
    mean, var = x.mean(), x.var()
    if dist == "genextreme":
        scale = math.sqrt(6 * var) / math.pi
        return 0.1, mean - 0.57722 * scale, scale
    if dist == "genpareto":
        at = 0.0 if loc is None else loc
        mean, var = (x - at).mean(), (x - at).var()
        c = 0.5 * (1 - mean**2 / var)
        return c, at, (1 - c) * mean
    if dist == "weibull_min":
        at = x.min() - 0.01 * x.std() if loc is None else loc
        c = math.pi / math.sqrt(6) / np.log(x - at).std()
        return c, at, ((x - at) ** c).mean() ** (1 / c)
    if dist not in ("gamma", "fisk"):
        raise ValueError(f"dist is one of {sorted(DENSITIES)}")
    at = _low_end(x) if loc is None else loc
    above = (x - at)[x > at]
    mean = above.mean()
    if dist == "gamma":
        gap = math.log(mean) - np.log(above).mean()
        c = (1 + math.sqrt(1 + 4 * gap / 3)) / (4 * gap)
        return c, at, mean / c
    square = (above**2).mean()
    return math.pi * mean / math.sqrt(3) / math.sqrt(square - mean**2), at, 2 * mean**3 / (square + mean**2)


def _log_genextreme(z: np.ndarray, c: float) -> np.ndarray:
    if abs(c) < 1e-9:
        return -z - np.exp(-z)
    t = 1 - c * z
    if t.min() <= 0:
        return np.full(len(z), -np.inf)
    return -(1 - 1 / c) * np.log(t) - np.exp(np.log(t) / c)


def _log_genpareto(z: np.ndarray, c: float) -> np.ndarray:
    if z.min() < 0 or (1 + c * z).min() <= 0:
        return np.full(len(z), -np.inf)
    return -z if abs(c) < 1e-9 else -(1 + 1 / c) * np.log1p(c * z)


def _positive(log: Callable[[np.ndarray, float], np.ndarray]) -> Callable[[np.ndarray, float], np.ndarray]:
    return lambda z, c: log(z, c) if z.min() > 0 and c > 0 else np.full(len(z), -np.inf)


#: Logarithms of the densities of (x - location) / scale.
DENSITIES: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "genextreme": _log_genextreme,
    "genpareto": _log_genpareto,
    "gamma": _positive(lambda z, c: (c - 1) * np.log(z) - z - math.lgamma(c)),
    "weibull_min": _positive(lambda z, c: math.log(c) + (c - 1) * np.log(z) - z**c),
    "fisk": _positive(lambda z, c: math.log(c) + (c - 1) * np.log(z) - 2 * np.log1p(z**c)),
}


def standard_moments(dist: str, c: float) -> tuple[float, float, float]:
    """Mean, variance and skewness at location 0 and scale 1."""
    if dist == "gamma":
        return c, c, 2 / math.sqrt(c)
    if dist == "genpareto":
        return 1 / (1 - c), 1 / ((1 - c) ** 2 * (1 - 2 * c)), 2 * (1 + c) * math.sqrt(1 - 2 * c) / (1 - 3 * c)
    if dist == "genextreme" and abs(c) < 1e-6:
        return 0.5772156649015329, math.pi**2 / 6, 1.1395470994046486
    if dist == "weibull_min":
        a, b, d = (math.gamma(1 + k / c) for k in (1, 2, 3))
    elif dist == "fisk":
        a, b, d = (k * math.pi / c / math.sin(k * math.pi / c) for k in (1, 2, 3))
    else:
        g1, g2, g3 = (math.gamma(1 + k * c) for k in (1, 2, 3))
        a, b, d = (1 - g1) / c, (1 - 2 * g1 + g2) / c**2, (1 - 3 * g1 + 3 * g2 - g3) / c**3
    var = b - a * a
    return a, var, (d - 3 * a * b + 2 * a**3) / var**1.5


#: Shapes between which the first three moments are there.
SHAPES = {"gamma": (1e-4, 1e6), "genpareto": (-20.0, 0.33), "genextreme": (-0.33, 20.0), "weibull_min": (0.1, 200.0), "fisk": (3.001, 1e4)}


def by_moments(x: np.ndarray, dist: str) -> tuple[float, float, float]:
    """The shape of the sample's skewness by bisection, then location and scale; the nearest shape if none has it."""
    mean, std = x.mean(), x.std()
    skew = ((x - mean) ** 3).mean() / std**3
    low, high = SHAPES[dist]
    rising = standard_moments(dist, high)[2] > standard_moments(dist, low)[2]
    for _ in range(200):
        middle = math.sqrt(low * high) if low > 0 and high / low > 4 else (low + high) / 2
        if (standard_moments(dist, middle)[2] < skew) == rising:
            low = middle
        else:
            high = middle
    c = (low + high) / 2
    m, v, _ = standard_moments(dist, c)
    scale = std / math.sqrt(v)
    return c, mean - scale * m, scale


def fit(x: np.ndarray, dist: str, method: str = "ML", loc: float | None = None) -> tuple[float, float, float]:
    """Shape, location and scale by maximum likelihood (ML), moments (MM), L-moments (PWM) or the first guess (APP); NaN where there is no fit.

    loc fixes the location for ML and APP.
    """
    if dist not in DENSITIES:
        raise ValueError(f"dist is one of {sorted(DENSITIES)}")
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    if len(x) < 3 or x.max() == x.min():
        return math.nan, math.nan, math.nan
    if method == "MM":
        return by_moments(x, dist)
    if method == "PWM":
        if dist == "genextreme":
            return fit_gev(x, "PWM")
        if dist != "genpareto":
            raise NotImplementedError("L-moments serve genextreme and genpareto")
        l1, l2, t3 = l_moments(x)
        k = (1 - 3 * t3) / (1 + t3)
        return -k, l1 - (2 + k) * l2, (1 + k) * (2 + k) * l2
    c, at, scale = first_guess(x, dist, loc)
    if method == "APP":
        return c, at, scale
    if method not in ("ML", "MLE"):
        raise NotImplementedError(f"unknown method {method!r}")
    if dist == "genpareto" and loc is None:
        loc = at

    def loss(q: np.ndarray) -> float:
        log = DENSITIES[dist]((x - (q[2] if loc is None else loc)) / math.exp(q[1]), q[0])
        return len(x) * q[1] - float(log.sum()) if np.isfinite(log).all() else math.inf

    start = np.array([c, math.log(scale)] + ([at] if loc is None else []))
    if not math.isfinite(loss(start)):
        start[0] = 0.1 if dist != "genextreme" else -0.1
    found = nelder_mead(loss, start)
    return float(found[0]), float(found[2]) if loc is None else loc, math.exp(found[1])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_pvalue(t: float, dof: float) -> float:
    """Two-sided."""
    if math.isnan(t) or dof <= 0:
        return math.nan
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


def rank_share(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis as shares, stretched from [least, greatest] to [0, greatest]; NaN stays NaN."""
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape[:-1]):
        row = x[i]
        known = ~np.isnan(row)
        _, kind, count = np.unique(row[known], return_inverse=True, return_counts=True)
        if len(count) > 1:
            r = (np.cumsum(count) - (count - 1) / 2)[kind] / known.sum()
            out[i][known] = r.max() * (r - r.min()) / (r.max() - r.min())
    return out


def rotations(n: int, count: int, seed: int = 0) -> np.ndarray:
    """Random orthogonal matrices, by QR of normal draws with the signs of R's diagonal."""
    rng = np.random.default_rng(seed)
    out = np.empty((count, n, n))
    for i in range(count):
        q, r = np.linalg.qr(rng.standard_normal((n, n)))
        out[i] = q * np.sign(np.diag(r))
    return out


def components(x: np.ndarray) -> np.ndarray:
    """Principal directions times their spreads, of rows of variables; covariance over n - 1."""
    u, s, _ = np.linalg.svd(np.atleast_2d(np.cov(x)))
    return u * np.sqrt(s)


def best_orientation(r: np.ndarray, h_inverse: np.ndarray, value: float = 1000.0) -> np.ndarray:
    """Signs of the components that leave a diagonal the least changed."""
    n = len(r)
    signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
    p = np.diag(np.full(n, value))
    return signs[np.argmin([np.linalg.norm(p - ((s * r) @ h_inverse) @ p) for s in signs])]


def best_orientation_full(r: np.ndarray, h_inverse: np.ndarray, r_mean: np.ndarray, h_mean: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Signs that give the highest mean rank correlation of hist before and after."""
    n = len(r)
    signs = 1 - 2 * ((np.arange(2**n)[:, None] >> np.arange(n)) & 1)
    before = rank_share(hist)

    def score(s: np.ndarray) -> float:
        after = rank_share(r_mean[:, None] + ((s * r) @ h_inverse) @ (hist - h_mean[:, None]))
        return float(np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(before, after)]))

    return signs[np.argmax([score(s) for s in signs])]


def total_distance(x: np.ndarray, y: np.ndarray) -> float:
    """The sum of the distances of all points of one cloud to all of the other, in blocks of rows; variables by points."""
    return float(sum(np.sqrt(((x[:, i : i + 256, None] - y[:, None, :]) ** 2).sum(axis=0)).sum() for i in range(0, x.shape[1], 256)))


def energy_score(x: np.ndarray, y: np.ndarray, n: int = 0, scale: bool = False) -> float:
    """Of two clouds, variables by points; n > 0 takes about n points of each, evenly spaced, scale measures in spreads of x."""
    x, y = x[:, ~np.isnan(x).any(axis=0)], y[:, ~np.isnan(y).any(axis=0)]
    if scale:
        x, mean, std = standardised(x)
        y = (y - mean) / std
    if n:
        x, y = (z[:, :: max(1, math.ceil(z.shape[1] / n))] for z in (x, y))
    a, b = x.shape[1], y.shape[1]
    if not a or not b:
        return math.nan
    return a * b / (a + b) * (2 * total_distance(x, y) / (a * b) - total_distance(x, x) / a**2 - total_distance(y, y) / b**2) / 2


def standardised(x: np.ndarray, mean: np.ndarray | None = None, std: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = np.nanmean(x, axis=1, keepdims=True) if mean is None else mean
    std = np.nanstd(x, axis=1, keepdims=True) if std is None else std
    return (x - mean) / std, mean, std


def interp_nearest(x: np.ndarray, xq: np.ndarray, yq: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.nan, yq[np.searchsorted((xq[1:] + xq[:-1]) / 2, x, "left")])


def lookup(interp: str, extrapolation: str = "constant") -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(x, knots, values) -> values at x; beyond the knots the end values, or NaN."""
    if interp not in ("nearest", "linear", "cubic") or extrapolation not in ("constant", "nan"):
        raise ValueError("interp is nearest, linear or cubic, extrapolation constant or nan")

    def at(x: np.ndarray, xq: np.ndarray, yq: np.ndarray) -> np.ndarray:
        if interp == "cubic" and len(xq) > 1:
            xq, first = np.unique(xq, return_index=True)
            out = cubic_spline(xq, yq[first])(np.clip(x, xq[0], xq[-1]))
        else:
            out = interp_nearest(x, xq, yq) if interp == "nearest" else np.interp(x, xq, yq)
        return np.where(np.isnan(x) | (extrapolation == "nan") & ((x < xq[0]) | (x > xq[-1])), np.nan, out)

    return at


def bends(xq: np.ndarray, yq: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the not-a-knot cubic spline; with three knots of the parabola, with fewer none."""
    n = len(xq)
    if n < 4:
        return np.full(n, 2 * np.polyfit(xq, yq, 2)[0] if n == 3 else 0.0)
    h, slope = np.diff(xq), np.diff(yq) / np.diff(xq)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, b)


def cubic_spline(xq: np.ndarray, yq: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The spline of bends() as a function."""
    n, m = len(xq), bends(xq, yq)
    h, slope = np.diff(xq), np.diff(yq) / np.diff(xq)

    def at(x: np.ndarray) -> np.ndarray:
        i = np.clip(np.searchsorted(xq, x, "right") - 1, 0, n - 2)
        t, hi = x - xq[i], h[i]
        return yq[i] + t * (slope[i] - hi * (2 * m[i] + m[i + 1]) / 6) + t**2 * m[i] / 2 + t**3 * (m[i + 1] - m[i]) / (6 * hi)

    return at


def lifted_cholesky(m: np.ndarray, rounds: int = 26) -> np.ndarray:
    """Lower factor; a diagonal that doubles is added until there is one."""
    lift = np.finfo(float).eps
    for i in range(rounds + 1):
        try:
            return np.linalg.cholesky(m if i == 0 else m + lift * np.eye(len(m)))
        except np.linalg.LinAlgError:
            lift *= 2 if i else 1
    raise np.linalg.LinAlgError("the matrix isn't positive definite, even when lifted")


def transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The exact plan of least cost that moves masses a to masses b: shortest augmenting paths with potentials.

    Rows first send what they can along columns of no reduced cost. Then each path is found by passing over
    columns in order of their distance, all of a row's columns at once. rounds bounds the number of paths.
    """
    n, m = cost.shape
    supply, demand = a.astype(float).copy(), b * (a.sum() / b.sum())
    plan = np.zeros((m, n))  # by column, as paths ask for the rows of a column
    small = 1e-12 * max(a.sum(), 1e-300)
    v = cost.min(axis=0) if n else np.zeros(m)
    u = (cost - v).min(axis=1) if m else np.zeros(n)
    for i in range(n):
        for j in np.flatnonzero((cost[i] - u[i] - v <= 0) & (demand > small)):
            amount = min(supply[i], demand[j])
            plan[j, i] += amount
            supply[i] -= amount
            demand[j] -= amount
            if supply[i] <= small:
                break
    paths = 0
    for start in range(n):
        while supply[start] > small and (demand > small).any():
            paths += 1
            if rounds is not None and paths > rounds:
                raise RuntimeError(f"no plan after {rounds} paths")
            far, origin = np.maximum(cost[start] - u[start] - v, 0), np.full(m, start)
            open_, row_far, row_from = np.ones(m, bool), np.full(n, np.inf), np.full(n, -1)
            row_far[start] = 0.0
            todo = far.copy()
            while True:
                goal = int(np.argmin(todo))
                if demand[goal] > small:
                    break
                open_[goal] = False
                todo[goal] = np.inf
                for i in np.flatnonzero((plan[goal] > small) & (row_far == np.inf)):
                    row_far[i], row_from[i] = far[goal], goal
                    reach = far[goal] + np.maximum(cost[i] - u[i] - v, 0)
                    better = open_ & (reach < far)
                    far[better], origin[better] = reach[better], i
                    todo[better] = reach[better]
            best = far[goal]
            seen = row_far < np.inf
            u[seen] += best - row_far[seen]
            v[~open_] -= best - far[~open_]
            path, j, amount = [], goal, min(supply[start], demand[goal])
            while True:
                i = int(origin[j])
                path.append((i, j))
                if i == start:
                    break
                j = int(row_from[i])
                amount = min(amount, plan[j, i])
                path.append((i, j))
            for k, (i, j) in enumerate(path):
                plan[j, i] += amount if k % 2 == 0 else -amount
            supply[start] -= amount
            demand[goal] -= amount
    return plan.T
