"""Multivariate adjustments and tails: kernels over the series of one site, or of one block of a site.

Frames are wide: site columns `by`, `time`, one column a variable. A site's series is one task's work, as
its rotations and transports need all of its points; sites are spread over the cluster.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.columns import nodes
from tidemark.operators import processing as P
from tidemark.operators.adjust import Model, register
from tidemark.operators.grouping import Grouper, grouped, time_blocks


def _schema(df: DataFrame, columns: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), *([more] if more else [])])


def _frames(keep: Sequence[str], **frames: DataFrame) -> DataFrame:
    """The frames one under the other, told apart by `_which`."""
    own = [df.select(*keep).withColumn("_which", F.lit(name)) for name, df in frames.items()]
    return functools.reduce(DataFrame.unionByName, own)


def _cloud(pdf: pd.DataFrame, which: str, variables: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray]:
    own = pdf[pdf["_which"] == which].sort_values("time")
    return own, own[list(variables)].to_numpy(float).T


def train_principal_components(ref: DataFrame, hist: DataFrame, *, variables: Sequence[str], group: str | Grouper = "time", best_orientation: str = "simple", by: Sequence[str] = ()) -> Model:
    """The map from the principal axes of hist to those of ref, by group: `trans`, row by row, and the means of ref."""
    if best_orientation not in ("simple", "full"):
        raise ValueError("best_orientation is simple or full")
    g, variables = Grouper.of(group), list(variables)
    both = grouped(_frames(ref=ref, hist=hist, keep=[*by, "time", *variables]), g, [*by, "_which"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (_, r), (_, h) = (_cloud(pdf, w, variables) for w in ("ref", "hist"))
        r, h = r[:, ~np.isnan(r).any(axis=0)], h[:, ~np.isnan(h).any(axis=0)]
        out = pdf[[*by, "grp"]].head(1).copy()
        if min(r.shape[1], h.shape[1]) <= len(variables):
            out["trans"], out["ref_mean"] = [None], [None]
            return out
        rm, hi = K.components(r), np.linalg.pinv(K.components(h))
        signs = K.best_orientation(rm, hi) if best_orientation == "simple" else K.best_orientation_full(rm, hi, r.mean(axis=1), h.mean(axis=1), h)
        out["trans"], out["ref_mean"] = [((signs * rm) @ hi).ravel().tolist()], [r.mean(axis=1).tolist()]
        return out

    table = both.groupBy(*by, "grp").applyInPandas(run, _schema(ref, by, "grp int, trans array<double>, ref_mean array<double>"))
    return Model("principal_components", {"variables": variables, "group": g.group, "window": g.window, "best_orientation": best_orientation, "by": list(by)}, table)


def adjust_principal_components(model: Model, sim: DataFrame) -> DataFrame:
    """(by, time, variables): sim less the means of its group, mapped, with the means of ref; where one variable is missing all are."""
    p = model.params
    variables, by = p["variables"], p["by"]
    own = grouped(sim.select(*by, "time", *variables), Grouper(p["group"], p["window"]), by)
    means = own.groupBy(*by, "grp").agg(*(F.avg(v).alias(f"_mean_{v}") for v in variables))
    own = own.where("main").join(means, [*by, "grp"]).join(model.table, [*by, "grp"], "left")
    n = len(variables)
    scen = [F.get("ref_mean", F.lit(i)) + sum((F.get("trans", F.lit(i * n + j)) * (F.col(v) - F.col(f"_mean_{v}")) for j, v in enumerate(variables)), F.lit(0.0)) for i in range(n)]
    return own.select(*by, "time", *(x.alias(v) for x, v in zip(scen, variables)))


def principal_components(ref: DataFrame, hist: DataFrame, sim: DataFrame, variables: Sequence[str], group: str | Grouper = "time", best_orientation: str = "simple", by: Sequence[str] = ()) -> DataFrame:
    """train_principal_components() and adjust_principal_components() in one."""
    return train_principal_components(ref, hist, variables=variables, group=group, best_orientation=best_orientation, by=by).adjust(sim)


#: A univariate adjustment within a kernel: (ref, hist, sim, nodes, kind) -> sim adjusted.
Base = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str], np.ndarray]


def _factors(ref: np.ndarray, hist: np.ndarray, q: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    r, h = np.nanquantile(ref, q), np.nanquantile(hist, q)
    return h, r - h if kind == "+" else r / h


def _qdm(ref: np.ndarray, hist: np.ndarray, sim: np.ndarray, q: np.ndarray, kind: str = "+") -> np.ndarray:
    af = K.interp_nearest(K.rank_share(sim), q, _factors(ref, hist, q, kind)[1])
    return sim + af if kind == "+" else sim * af


def _eqm(ref: np.ndarray, hist: np.ndarray, sim: np.ndarray, q: np.ndarray, kind: str = "+") -> np.ndarray:
    af = K.interp_nearest(sim, *_factors(ref, hist, q, kind))
    return sim + af if kind == "+" else sim * af


def _dqm(ref: np.ndarray, hist: np.ndarray, sim: np.ndarray, q: np.ndarray, kind: str = "+") -> np.ndarray:
    """Means apart, without a trend of sim."""
    r, h, s = np.nanmean(ref), np.nanmean(hist), np.nanmean(sim)
    if kind == "+":
        return _eqm(ref - r, hist - h, sim - s, q, kind) + s + r - h
    return _eqm(ref / r, hist / h, sim / s, q, kind) * s * r / h


BASES: dict[str, Base] = {"qdm": _qdm, "eqm": _eqm, "dqm": _dqm}


def _base(base: str | Base) -> Base:
    if not callable(base) and base not in BASES:
        raise ValueError(f"base is a function or one of {sorted(BASES)}")
    return base if callable(base) else BASES[base]


def _turns(variables: Sequence[str], n_iter: int, seed: int, given: Sequence | None) -> np.ndarray:
    turns = K.rotations(len(variables), n_iter, seed) if given is None else np.asarray(given, float)
    if turns.ndim != 3 or turns.shape[1:] != (len(variables),) * 2:
        raise ValueError("rotations are square matrices of the variables")
    return turns


def npdf_transform(ref: DataFrame, hist: DataFrame, sim: DataFrame, variables: Sequence[str], n_iter: int = 20, nquantiles: int = 20, by: Sequence[str] = (), seed: int = 0, base: str | Base = "qdm", n_escore: int = -1, rotations: Sequence | None = None, output: str = "scen") -> DataFrame:
    """Rotations of all variables, each with a mapping of every axis by `base`.

    output: scen, (by, time, variables) of sim; scenh, the same of hist; escores, (by, iteration, escore), the
    energy distance of ref and hist after each rotation, from about n_escore points (0: all; below 0: none).
    rotations may be given; else n_iter are drawn by the seed.
    """
    if output not in ("scen", "scenh", "escores"):
        raise ValueError("output is scen, scenh or escores")
    q, turns, one = np.array(nodes(nquantiles)), _turns(variables, n_iter, seed, rotations), _base(base)
    variables, keep = list(variables), [*by, "time", *variables]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (_, r), (past, h), (rows, s) = (_cloud(pdf, w, variables) for w in ("ref", "hist", "sim"))
        r, mean, spread = K.standardised(r)
        h, s = (h - mean) / spread, (s - mean) / spread
        scores = []
        for turn in turns:
            rt, ht, st = turn @ r, turn @ h, turn @ s
            new_h = np.array([one(a, b, b, q, "+") for a, b in zip(rt, ht)])
            new_s = np.array([one(a, b, c, q, "+") for a, b, c in zip(rt, ht, st)])
            h, s = turn.T @ new_h, turn.T @ new_s
            scores.append(K.energy_score(r, h, n_escore) if n_escore >= 0 and output == "escores" else np.nan)
        if output == "escores":
            return pdf[list(by)].head(1).merge(pd.DataFrame({"iteration": np.arange(1, len(turns) + 1, dtype=np.int32), "escore": scores}), how="cross") if by else pd.DataFrame({"iteration": np.arange(1, len(turns) + 1, dtype=np.int32), "escore": scores})
        out = (rows if output == "scen" else past)[[*by, "time"]].copy()
        out[variables] = ((s if output == "scen" else h) * spread + mean).T
        return out

    schema = _schema(ref, by, "iteration int, escore double") if output == "escores" else _schema(ref, keep, "")
    return _frames(ref=ref, hist=hist, sim=sim, keep=keep).groupBy(*(by or [F.lit("all")])).applyInPandas(run, schema)


def train_mbcn(ref: DataFrame, hist: DataFrame, *, variables: Sequence[str], group: str = "time", window: int = 1, n_iter: int = 20, nquantiles: int = 20, n_escore: int = -1, rotations: Sequence | None = None, interp: str = "nearest", extrapolation: str = "constant", by: Sequence[str] = (), seed: int = 0) -> Model:
    """By blocks of time: `af`, the factors of each rotation, axis and quantile, one behind the other, and `escores` as of npdf_transform()."""
    if group not in ("time", "time.dayofyear", "5D"):
        raise ValueError("group is time, time.dayofyear or 5D")
    if interp not in ("nearest", "linear") or extrapolation not in ("constant", "nan"):
        raise ValueError("interp is nearest or linear, extrapolation constant or nan")
    variables, q, turns = list(variables), np.array(nodes(nquantiles)), _turns(variables, n_iter, seed, rotations)
    look_up = K.lookup(interp, extrapolation)
    keep = [*by, "time", *variables]
    blocks = time_blocks(_frames(ref=ref, hist=hist, keep=keep), group, window, [*by, "_which"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (_, r), (_, h) = (_cloud(pdf, w, variables) for w in ("ref", "hist"))
        out = pdf[[*by, "block"]].head(1).copy()
        if not (r.size and h.size):
            out["af"], out["escores"] = [None], [None]
            return out
        r, h = (K.standardised(x)[0] for x in (r, h))
        last, af, scores = np.eye(len(variables)), np.empty((len(turns), len(variables), len(q))), []
        for i, turn in enumerate(turns):
            step, last = turn @ last.T, turn
            r, h = step @ r, step @ h
            for v in range(len(variables)):
                af[i, v] = np.nanquantile(r[v], q) - np.nanquantile(h[v], q)
                h[v] += look_up(K.rank_share(h[v]), q, af[i, v])
            scores.append(K.energy_score(r, h, n_escore) if n_escore >= 0 else None)
        out["af"], out["escores"] = [af.ravel().tolist()], [scores]
        return out

    table = blocks.groupBy(*by, "block").applyInPandas(run, _schema(ref, by, "block int, af array<double>, escores array<double>"))
    params = {"variables": variables, "group": group, "window": window, "nquantiles": nquantiles, "rotations": turns.tolist(), "interp": interp, "extrapolation": extrapolation, "by": list(by)}
    return Model("mbcn", params, table)


def adjust_mbcn(model: Model, sim: DataFrame, ref: DataFrame, hist: DataFrame, base: str | Base = "qdm", kinds: dict[str, str] | None = None, nquantiles: dict[str, int] | None = None) -> DataFrame:
    """(by, time, variables): each variable adjusted on its own by `base`, then put in the order that the trained rotations give sim; by blocks of time."""
    p = model.params
    variables, by, kinds, one = p["variables"], p["by"], kinds or {}, _base(base)
    q, turns, look_up = np.array(nodes(p["nquantiles"])), np.array(p["rotations"]), K.lookup(p["interp"], p["extrapolation"])
    own_q = [np.array(nodes((nquantiles or {}).get(v, p["nquantiles"]))) for v in variables]
    keep = [*by, "time", *variables]
    blocks = time_blocks(_frames(ref=ref, hist=hist, sim=sim, keep=keep), p["group"], p["window"], [*by, "_which"])

    def run(pdf: pd.DataFrame, trained: pd.DataFrame) -> pd.DataFrame:
        (_, r), (_, h), (rows, s) = (_cloud(pdf, w, variables) for w in ("ref", "hist", "sim"))
        out = rows[[*by, "time"]].copy()
        if not (r.size and h.size and s.size) or not len(trained) or trained["af"].iloc[0] is None:
            out[variables] = s.T
            return out[rows["main"].to_numpy(bool)]
        alone = np.array([one(a, b, c, n, kinds.get(v, "+")) for v, a, b, c, n in zip(variables, r, h, s, own_q)])
        af = np.array(trained["af"].iloc[0], float).reshape(len(turns), len(variables), len(q))
        s, last = K.standardised(s)[0], np.eye(len(variables))
        for turn, own in zip(turns, af):
            s, last = (turn @ last.T) @ s, turn
            for v in range(len(variables)):
                s[v] += look_up(K.rank_share(s[v]), q, own[v])
        place = np.argsort(np.argsort(last.T @ s, axis=1, kind="stable"), axis=1, kind="stable")
        out[variables] = np.take_along_axis(np.sort(alone, axis=1), place, axis=1).T
        return out[rows["main"].to_numpy(bool)]

    return blocks.groupBy(*by, "block").cogroup(model.table.groupBy(*by, "block")).applyInPandas(run, _schema(sim, keep, ""))


def mbcn(ref: DataFrame, hist: DataFrame, sim: DataFrame, variables: Sequence[str], kinds: dict[str, str] | None = None, base: str | Base = "qdm", **training) -> DataFrame:
    """train_mbcn() and adjust_mbcn() in one."""
    return train_mbcn(ref, hist, variables=variables, **training).adjust(sim, ref=ref, hist=hist, base=base, kinds=kinds)


def _widths(*clouds: np.ndarray) -> np.ndarray:
    out = []
    for x in clouds:
        n = x.shape[1] ** (-1 / 3)
        iqr = np.subtract(*np.percentile(x, [75, 25], axis=1))
        out.append(np.where(iqr > 0, 2 * iqr * n, 3.49 * x.std(axis=1) * n))
    return np.min(out, axis=0)


def _given(value: dict | float | Sequence[float] | None, variables: Sequence[str], default: float) -> np.ndarray | None:
    """A number for each variable, from one for all, a list, or those of some by name."""
    if value is None:
        return None
    if isinstance(value, dict):
        return np.array([float(value.get(v, default)) for v in variables])
    return np.full(len(variables), float(value)) if np.isscalar(value) else np.asarray(value, float)


def _adapted(ref: DataFrame, df: DataFrame, thresholds: dict[str, float] | float | None, variables: Sequence[str], group: Grouper, by: Sequence[str]) -> DataFrame:
    """df with the dry values of its variables adapted to the frequency of ref's, variable by variable."""
    if thresholds is None:
        return df
    for i, (v, t) in enumerate((thresholds if isinstance(thresholds, dict) else dict.fromkeys(variables, thresholds)).items()):
        df = P.adapt_freq(ref, df, group, float(t), by, v, seed=19 + i)[0].drop("grp")
    return df


def _transported(x: np.ndarray, y: np.ndarray, width: np.ndarray | None, normalization: str | None, rng: np.random.Generator, spread: bool, origin: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
    """Each point of x moved to a cell of y, drawn by the row of the exact transport plan of its own cell.

    The plan takes memory with the product of the numbers of filled cells, in one task: widths bound these.
    A width of 0 is that of the data.
    """
    width = _widths(x, y) if width is None else np.where(width > 0, width, _widths(x, y))
    width = np.where(width > 0, width, 1.0)
    origin = np.zeros((len(x), 1)) if origin is None else origin[:, None]

    def cells(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, kind, count = np.unique(np.floor((z - origin) / width[:, None]), axis=1, return_inverse=True, return_counts=True)
        return (which + 0.5) * width[:, None] + origin, count / count.sum(), kind.ravel()

    (cx, mx, kx), (cy, my, _) = cells(x), cells(y)
    nx, ny = cx, cy
    if normalization == "standardize":
        both = np.concatenate([cx, cy], axis=1)
        mean, std = both.mean(axis=1, keepdims=True), both.std(axis=1, keepdims=True)
        nx, ny = (cx - mean) / std, (cy - mean) / std
    elif normalization in ("max_distance", "max_value"):
        by = np.abs(cx[:, :, None] - cy[:, None, :]).max(axis=(1, 2)) if normalization == "max_distance" else np.maximum(cx.max(axis=1), cy.max(axis=1))
        by = np.where(by == 0, 1, by)[:, None]
        nx, ny = cx / by, cy / by
    elif normalization is not None:
        raise ValueError("normalization is standardize, max_distance, max_value or None")
    plan = K.transport(((nx[:, :, None] - ny[:, None, :]) ** 2).sum(axis=0), mx, my, rounds)
    shares = np.cumsum(plan / plan.sum(axis=1, keepdims=True), axis=1)
    to = np.array([min(np.searchsorted(shares[k], u, "right"), shares.shape[1] - 1) for k, u in zip(kx, rng.random(len(kx)))])
    return cy[:, to] + (rng.uniform(-0.5, 0.5, x.shape) * width[:, None] if spread else 0)


def otc(ref: DataFrame, hist: DataFrame, variables: Sequence[str], bin_width: dict | float | Sequence[float] | None = None, bin_origin: dict | float | None = None, num_iter_max: int | None = None, adapt_freq_thresh: dict | float | None = None, normalization: str | None = "max_distance", jitter_inside_bins: bool = True, group: str | Grouper = "time", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, time, variables): hist moved to ref by optimal transport of their histograms. Points with missing values stay missing.

    bin_width and bin_origin: one for all variables, or by name; num_iter_max: augmenting paths after which the
    transport gives up with an error.
    """
    g, variables = Grouper.of(group), list(variables)
    keep = [*by, "time", *variables]
    both = grouped(_frames(ref=ref, hist=_adapted(ref, hist, adapt_freq_thresh, variables, g, by), keep=keep), g, [*by, "_which"])
    width, origin = _given(bin_width, variables, 0.0), _given(bin_origin, variables, 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, r = _cloud(pdf, "ref", variables)
        rows, h = _cloud(pdf, "hist", variables)
        rng = np.random.default_rng([seed, len(rows), int(pdf["grp"].iloc[0]) + 1])
        known = ~np.isnan(h).any(axis=0)
        out = np.full(h.shape, np.nan)
        r = r[:, ~np.isnan(r).any(axis=0)]
        if known.any() and r.size:
            out[:, known] = _transported(h[:, known], r, width, normalization, rng, jitter_inside_bins, origin, num_iter_max)
        new = rows[[*by, "time"]].copy()
        new[variables] = out.T
        return new[rows["main"].to_numpy(bool)]

    return both.groupBy(*by, "grp").applyInPandas(run, _schema(ref, keep, ""))


def dotc(ref: DataFrame, hist: DataFrame, sim: DataFrame, variables: Sequence[str], kinds: dict[str, str] | None = None, cov_factor: str | None = "std", bin_width: dict | float | Sequence[float] | None = None, bin_origin: dict | float | None = None, num_iter_max: int | None = None, adapt_freq_thresh: dict | float | None = None, normalization: str | None = "max_distance", jitter_inside_bins: bool = True, group: str | Grouper = "time", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, time, variables): sim moved to what ref becomes by the motion from hist to sim."""
    kinds = kinds or {}
    if cov_factor not in ("std", "cholesky", None) or cov_factor == "cholesky" and "*" in kinds.values():
        raise ValueError("cov_factor is std, None, or cholesky where all kinds are +")
    g, variables = Grouper.of(group), list(variables)
    keep = [*by, "time", *variables]
    hist, sim = (_adapted(ref, df, adapt_freq_thresh, variables, g, by) for df in (hist, sim))
    both = grouped(_frames(ref=ref, hist=hist, sim=sim, keep=keep), g, [*by, "_which"])
    origin = _given(bin_origin, variables, 0.0)
    ratio = np.array([kinds.get(v, "+") == "*" for v in variables])[:, None]
    width = _given(bin_width, variables, 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (_, y0), (_, x0) = (_cloud(pdf, w, variables) for w in ("ref", "hist"))
        rows, x1 = _cloud(pdf, "sim", variables)
        rng = np.random.default_rng([seed, len(rows), int(pdf["grp"].iloc[0]) + 1])
        known = ~np.isnan(x1).any(axis=0)
        y0, x0 = y0[:, ~np.isnan(y0).any(axis=0)], x0[:, ~np.isnan(x0).any(axis=0)]
        out = np.full(x1.shape, np.nan)
        if known.any() and y0.size and x0.size:
            a = _transported(y0, x0, width, normalization, rng, False, origin, num_iter_max)
            b = _transported(a, x1[:, known], width, normalization, rng, False, origin, num_iter_max)
            motion = np.where(ratio, b / np.where(a == 0, np.nan, a), b - a)
            if cov_factor == "std":
                by_std = y0.std(axis=1, keepdims=True) * x0.std(axis=1, keepdims=True) ** -1
                motion = np.where(ratio, motion, by_std * motion)
            elif cov_factor == "cholesky":
                motion = K.lifted_cholesky(np.cov(y0)) @ np.linalg.inv(K.lifted_cholesky(np.cov(x0))) @ motion
            y1 = np.where(ratio, y0 * np.nan_to_num(motion, nan=1.0), y0 + motion)
            out[:, known] = _transported(x1[:, known], y1, width, normalization, rng, jitter_inside_bins, origin, num_iter_max)
        new = rows[[*by, "time"]].copy()
        new[variables] = out.T
        return new[rows["main"].to_numpy(bool)]

    return both.groupBy(*by, "grp").applyInPandas(run, _schema(ref, keep, ""))


def _peaks(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Maxima of the runs above `low` whose maximum is above `high`."""
    inside = np.concatenate([[False], x > low, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    tops = np.array([x[a:b].max() for a, b in zip(edges[::2], edges[1::2])])
    return tops[tops > high] if len(tops) else tops


def train_extreme_values(ref: DataFrame, hist: DataFrame, *, cluster_thresh: float, q_thresh: float = 0.95, ref_params: DataFrame | None = None, by: Sequence[str] = (), value: str = "value") -> Model:
    """Of each site `thresh`, generalised Pareto fits (shape, scale) of the cluster maxima of ref and hist, and `af` at the probabilities `px_hist`.

    ref_params: (by, shape, scale) to use in place of a fit to ref. Where a fit is impossible af is NULL.
    """
    keep = [*by, "time", value]
    both = _frames(ref=ref, hist=hist, keep=keep)
    fixed = ref_params is not None
    if fixed:
        given = ref_params.select(*by, F.col("shape").alias("_shape"), F.col("scale").alias("_scale"))
        both = both.join(given, list(by), "left") if by else both.crossJoin(F.broadcast(given))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, h = (pdf[pdf["_which"] == w].sort_values("time")[value].to_numpy(float) for w in ("ref", "hist"))
        out = pdf[list(by)].head(1).reset_index(drop=True).copy() if by else pd.DataFrame(index=[0])
        for c in ("thresh", "fit_ref", "fit_hist", "px_hist", "af"):
            out[c] = [None]
        if not ((r >= cluster_thresh).any() and (h >= cluster_thresh).any()):
            return out
        t = 0.5 * (np.quantile(r[r >= cluster_thresh], q_thresh) + np.quantile(h[h >= cluster_thresh], q_thresh))
        fits = [K.fit_gpd(_peaks(x[~np.isnan(x)], cluster_thresh, t) - t) for x in (r, h)]
        if fixed:
            fits[0] = tuple(pdf[["_shape", "_scale"]].iloc[0].astype(float))
        out["thresh"] = t
        if np.isnan(fits).any():
            return out
        tails = [np.sort(x[x >= t]) for x in (r, h)]
        pr, ph = (K.gpd_cdf(x, *f, t) for x, f in zip(tails, fits))
        out["fit_ref"], out["fit_hist"] = [list(fits[0])], [list(fits[1])]
        if len(pr) and len(ph):
            fit = (ph >= max(pr.min(), ph.min())) & (ph <= min(pr.max(), ph.max())) & (ph < 1)
            if fit.any():
                out["px_hist"], out["af"] = [ph[fit].tolist()], [(K.gpd_ppf(ph[fit], *fits[0], t) / tails[1][fit]).tolist()]
        return out

    schema = _schema(ref, by, "thresh double, fit_ref array<double>, fit_hist array<double>, px_hist array<double>, af array<double>")
    return Model("extreme_values", {"cluster_thresh": cluster_thresh, "q_thresh": q_thresh, "by": list(by), "value": value}, both.groupBy(*(by or [F.lit("all")])).applyInPandas(run, schema))


def adjust_extreme_values(model: Model, sim: DataFrame, scen: DataFrame, frac: float = 0.7, power: float = 3.0, interp: str = "linear", extrapolation: str = "constant") -> DataFrame:
    """(by, time, value): scen with its tail adjusted by the factors at sim's own probabilities, blended in from the threshold up."""
    if not 0 < frac <= 1:
        raise ValueError("frac is above 0 and at most 1")
    p = model.params
    by, value, look_up = p["by"], p["value"], K.lookup(interp, extrapolation)
    keep = [*by, "time", value]
    two = _frames(sim=sim, scen=scen, keep=keep)
    table = model.table

    def run(pdf: pd.DataFrame, trained: pd.DataFrame) -> pd.DataFrame:
        own = {w: pdf[pdf["_which"] == w].sort_values("time") for w in ("sim", "scen")}
        both = own["sim"][[*by, "time", value]].merge(own["scen"][["time", value]], on="time", suffixes=("", "_scen"))
        out = both[[*by, "time"]].copy()
        out[value] = both[f"{value}_scen"].to_numpy(float)
        if not len(trained) or trained["af"].iloc[0] is None:
            return out
        t, px, af = float(trained["thresh"].iloc[0]), np.array(trained["px_hist"].iloc[0]), np.array(trained["af"].iloc[0])
        s = own["sim"][value].to_numpy(float)
        fit = K.fit_gpd(_peaks(s[~np.isnan(s)], p["cluster_thresh"], t) - t)
        if np.isnan(fit).any():
            return out
        x = both[value].to_numpy(float)
        over = np.maximum(x - t, 0)
        adjusted = x * look_up(K.gpd_cdf(x, *fit, t), px, af)
        top = np.nanmax(x) - t
        tau = np.clip((over / top / frac) ** power, 0, 1) if top > 0 else np.zeros(len(x))
        out[value] = np.where(over > 0, tau * adjusted + (1 - tau) * out[value], out[value])
        return out

    keys = list(by) or ["_all"]
    if not by:
        two, table = two.withColumn("_all", F.lit(1)), table.withColumn("_all", F.lit(1))
    return two.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(run, _schema(sim, keep, ""))


def extreme_values(ref: DataFrame, hist: DataFrame, sim: DataFrame, scen: DataFrame, *, cluster_thresh: float, q_thresh: float = 0.95, frac: float = 0.7, power: float = 3.0, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """train_extreme_values() and adjust_extreme_values() in one."""
    return train_extreme_values(ref, hist, cluster_thresh=cluster_thresh, q_thresh=q_thresh, by=by, value=value).adjust(sim, scen=scen, frac=frac, power=power)


def _at_once(f: Callable) -> tuple[Callable, Callable]:
    """A method that learns and applies in one: training keeps the frames' plans, which can't be saved."""
    def fit(ref: DataFrame, hist: DataFrame, **params) -> Model:
        return Model(f.__name__, params, ref, {"hist": hist})

    def predict(model: Model, sim: DataFrame | None = None, **options) -> DataFrame:
        own = {**model.params, **options}
        variables = own.pop("variables")
        frames = [model.table, model.extra["hist"]]
        # without sim, hist is adjusted
        return f(*frames, variables, **own) if f is otc else f(*frames, model.extra["hist"] if sim is None else sim, variables, **own)

    return fit, predict


register("principal_components", train_principal_components, adjust_principal_components)
register("mbcn", train_mbcn, adjust_mbcn)
register("extreme_values", train_extreme_values, adjust_extreme_values)
for _f in (npdf_transform, otc, dotc):
    register(_f.__name__, *_at_once(_f))
