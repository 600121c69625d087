"""Multivariate methods, splines, fits and the library's other parts: against plain versions, saved and read again, and error contracts."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import inputs, kernels as K, offsets, provenance, units
from tidemark.operators import adjust as A
from tidemark.operators import detrend as D
from tidemark.operators import mapping
from tidemark.operators import multivariate as V
from tidemark.operators import periods as T
from tidemark.operators import processing as P
from tidemark.operators import properties as R
from tidemark.operators import stats as S
from tidemark.operators.grouping import Grouper, broadcast_groups, longest_days
from tidemark.plans import contract  # noqa: F401  registers its queries
from tidemark.plans.registry import QUERIES
from tidemark.sources import generators

DAYS = pd.date_range("2001-01-01", periods=60)


def wide(spark, z, start=0):
    return spark.createDataFrame([("a", d.date(), *map(float, row)) for d, row in zip(DAYS[start:], np.asarray(z).T)], "site string, time date, u double, v double")


def clouds(n=40, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.multivariate_normal(m, c, n).T for m, c in (([10, 3], [[1, 0.6], [0.6, 2]]), ([12, 5], [[2, -0.5], [-0.5, 1]]), ([13, 6], [[2, -0.2], [-0.2, 1]]))]


def frames(spark, n=40, seed=0):
    return [wide(spark, z) for z in clouds(n, seed)]


def values(df):
    return df.orderBy("time").toPandas()[["u", "v"]].to_numpy().T


# plain versions, point by point

NODES = [(i + 0.5) / 10 for i in range(10)]


def plain_rank(x):
    r = [(sum(b < a for b in x) + (1 + sum(b == a for b in x)) / 2) / len(x) for a in x]
    return [max(r) * (a - min(r)) / (max(r) - min(r)) for a in r]


def plain_quantile(x, q):
    x = sorted(x)
    k = q * (len(x) - 1)
    low = math.floor(k)
    return x[low] + (k - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def plain_nearest(at, knots, ys):
    return ys[min(range(len(knots)), key=lambda i: (abs(knots[i] - at), i))]


def plain_qdm(ref, hist, sim):
    af = [plain_quantile(ref, q) - plain_quantile(hist, q) for q in NODES]
    return np.array([x + plain_nearest(r, NODES, af) for x, r in zip(sim, plain_rank(sim))])


TURNS = K.rotations(2, 3, seed=5)


def close_ranks(x):
    """Ranks never lie half-way between two nodes here, where engines may choose either."""
    return all(min(abs(r - (a + b) / 2) for a, b in itertools.pairwise(NODES)) > 1e-9 for r in plain_rank(x))


def test_rotated_mappings_equal_a_plain_version(spark):
    r, h, s = clouds(38)
    assert close_ranks(s[0])
    ref, hist, sim = frames(spark, 38)
    mean, std = r.mean(axis=1, keepdims=True), r.std(axis=1, keepdims=True)
    rz, hz, sz = ((z - mean) / std for z in (r, h, s))
    for turn in TURNS:
        rt, ht, st = turn @ rz, turn @ hz, turn @ sz
        sz = turn.T @ np.array([plain_qdm(a, b, c) for a, b, c in zip(rt, ht, st)])
        hz = turn.T @ np.array([plain_qdm(a, b, b) for a, b in zip(rt, ht)])
    options = {"nquantiles": 10, "rotations": TURNS.tolist(), "by": ["site"]}
    assert np.allclose(values(V.npdf_transform(ref, hist, sim, ["u", "v"], **options)), sz * std + mean)
    assert np.allclose(values(V.npdf_transform(ref, hist, sim, ["u", "v"], output="scenh", **options)), hz * std + mean)
    scores = V.npdf_transform(ref, hist, sim, ["u", "v"], output="escores", n_escore=0, **options).orderBy("iteration").toPandas()
    assert np.isclose(scores["escore"].iloc[-1], K.energy_score(rz, hz))
    with pytest.raises(ValueError):
        V.npdf_transform(ref, hist, sim, ["u", "v"], output="none")
    with pytest.raises(ValueError):
        V.npdf_transform(ref, hist, sim, ["u", "v"], base="none")


def plain_mbcn(r, h, s):
    alone = np.array([plain_qdm(*z) for z in zip(r, h, s)])
    r, h, s = ((z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True) for z in (r, h, s))
    for turn in TURNS:
        r, h, s = turn @ r, turn @ h, turn @ s
        for v in range(2):
            af = [plain_quantile(r[v], q) - plain_quantile(h[v], q) for q in NODES]
            h[v], s[v] = ([x + plain_nearest(k, NODES, af) for x, k in zip(z[v], plain_rank(z[v]))] for z in (h, s))
        r, h, s = turn.T @ r, turn.T @ h, turn.T @ s
    return np.array([np.sort(a)[[sorted(row).index(x) for x in row]] for a, row in zip(alone, s)])


def test_mbcn_equals_a_plain_version_and_comes_back_from_files(spark, tmp_path):
    ref, hist, sim = frames(spark, 38)
    model = A.train("mbcn", ref, hist, variables=["u", "v"], nquantiles=10, rotations=TURNS.tolist(), n_escore=0, by=["site"])
    out = values(model.adjust(sim, ref=ref, hist=hist))
    assert np.allclose(out, plain_mbcn(*clouds(38)))
    assert len(model.table.first().escores) == 3
    model.save(f"file://{tmp_path}/m")
    again = A.Model.load(spark, f"file://{tmp_path}/m")
    assert np.array_equal(values(again.adjust(sim, ref=ref, hist=hist)), out)
    for base in ("eqm", "dqm", lambda r, h, s, q, kind: s):
        got = values(model.adjust(sim, ref=ref, hist=hist, base=base))
        assert got.shape == out.shape and not np.isnan(got).any()
    with pytest.raises(ValueError, match="times"):
        A.train("mbcn", ref, wide(spark, clouds(38)[1], start=2), variables=["u", "v"], by=["site"])


def test_mbcn_by_blocks_of_days(spark):
    r, h, s = clouds(50, seed=3)
    out = V.mbcn(*frames(spark, 50, seed=3), ["u", "v"], group="5D", window=3, nquantiles=10, rotations=TURNS.tolist(), by=["site"])
    got = values(out)
    block = np.arange(50) // 5
    for b in range(2, 8):  # blocks whose neighbours lie in the record
        near = np.abs(block - b) <= 1
        want = plain_mbcn(r[:, near], h[:, near], s[:, near])[:, block[near] == b]
        assert np.allclose(got[:, block == b], want)


def best(x, y):
    """Of points that each fill a cell the places in y that cost the least."""
    return list(min(itertools.permutations(range(y.shape[1])), key=lambda p: ((x - y[:, list(p)]) ** 2).sum()))


def test_transport_methods_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    r, h, s = (np.round(rng.random((2, 6)) * 40) + 0.5 for _ in range(3))
    ref, hist, sim = (wide(spark, z) for z in (r, h, s))
    options = {"bin_width": 1, "normalization": None, "jitter_inside_bins": False, "by": ["site"]}
    assert np.allclose(values(V.otc(ref, hist, ["u", "v"], **options)), r[:, best(h, r)])
    a = h[:, best(r, h)]
    motion = s[:, best(a, s)] - a
    y1 = np.floor(r + motion) + 0.5
    assert len({tuple(c) for c in y1.T}) == 6
    assert np.allclose(values(V.dotc(ref, hist, sim, ["u", "v"], cov_factor=None, **options)), y1[:, best(s, y1)])
    both = values(A.train("otc", ref, hist, variables=["u", "v"], **options).adjust())
    assert np.allclose(both, r[:, best(h, r)])
    moved = values(V.otc(ref, hist, ["u", "v"], **options | {"bin_origin": {"u": 0.25}}))
    assert np.allclose(moved[0] % 1, 0.75) and np.allclose(moved[1] % 1, 0.5)
    with pytest.raises(Exception, match="no plan"):
        V.otc(ref, hist, ["u", "v"], num_iter_max=0, **options).collect()


def test_transport_of_unlike_masses():
    rng = np.random.default_rng(1)
    for n, m in ((3, 4), (5, 3), (4, 4)):
        a, b = rng.integers(1, 4, n), rng.integers(1, 4, m)
        a[0] += max(0, b.sum() - a.sum())
        b[0] += max(0, a.sum() - b.sum())
        cost = rng.random((n, m))
        plan = K.transport(cost, a.astype(float), b.astype(float))
        assert np.allclose(plan.sum(axis=1), a) and np.allclose(plan.sum(axis=0), b)
        # units of mass one by one
        rows, columns = np.repeat(np.arange(n), a), np.repeat(np.arange(m), b)
        if len(rows) <= 8:
            least = min(cost[rows, columns[list(p)]].sum() for p in itertools.permutations(range(len(columns))))
            assert np.isclose((plan * cost).sum(), least)


def series(spark, x, site="a", start="2000-01-01"):
    return spark.createDataFrame([(site, d.date(), None if v is None else float(v)) for d, v in zip(pd.date_range(start, periods=len(x)), x)], "site string, time date, value double")


def test_extreme_values_equal_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(3)
    r, h, s = (rng.gamma(2, k, 900) for k in (6, 5, 5.5))
    ref, hist, sim = (series(spark, x) for x in (r, h, s))
    model = A.train("extreme_values", ref, hist, cluster_thresh=12.0, q_thresh=0.6, by=["site"])
    row = model.table.first()
    t = 0.5 * (np.quantile(r[r >= 12], 0.6) + np.quantile(h[h >= 12], 0.6))
    assert np.isclose(row.thresh, t)

    def peaks(x):
        runs = [list(g) for k, g in itertools.groupby(x, lambda v: v > 12) if k]
        return np.array([max(g) for g in runs if max(g) > t]) - t

    def likelihood(x, c, scale):
        inner = 1 + c * x / scale
        return -np.inf if scale <= 0 or inner.min() <= 0 else -len(x) * math.log(scale) - (1 + 1 / c) * np.log(inner).sum()

    for x, (c, scale) in ((peaks(r), row.fit_ref), (peaks(h), row.fit_hist)):
        top = likelihood(x, c, scale)
        assert all(likelihood(x, c + a, scale * b) <= top + 1e-6 for a in (-0.02, 0.013, 0.02) for b in (0.97, 1.02))
    cdf = lambda x, c, scale: 1 - (1 + c * np.maximum(x - t, 0) / scale) ** (-1 / c)
    tail = np.sort(h[h >= t])
    ph, pr = cdf(tail, *row.fit_hist), cdf(r[r >= t], *row.fit_ref)
    inside = (ph >= max(pr.min(), ph.min())) & (ph <= min(pr.max(), ph.max()))
    c, scale = row.fit_ref
    af = (t + scale * ((1 - ph[inside]) ** -c - 1) / c) / tail[inside]
    assert np.allclose(row.px_hist, ph[inside]) and np.allclose(row.af, af)
    fit = K.fit_gpd(peaks(s))
    want = []
    for x in s:
        new = x * np.interp(cdf(np.array(x), *fit), ph[inside], af)
        tau = min(1, (max(x - t, 0) / (s.max() - t) / 0.5) ** 2)
        want.append(tau * new + (1 - tau) * (x + 1) if x > t else x + 1)
    out = model.adjust(sim, scen=series(spark, s + 1), frac=0.5, power=2).orderBy("time").toPandas()["value"]
    assert np.allclose(out, want)
    model.save(f"file://{tmp_path}/m")
    assert np.allclose(A.Model.load(spark, f"file://{tmp_path}/m").adjust(sim, scen=series(spark, s + 1), frac=0.5, power=2).orderBy("time").toPandas()["value"], want)
    own = spark.createDataFrame([("a", 0.1, 4.0)], "site string, shape double, scale double")
    assert A.train("extreme_values", ref, hist, cluster_thresh=12.0, ref_params=own, by=["site"]).table.first().fit_ref == [0.1, 4.0]
    # nothing above the threshold: scen stays
    assert A.train("extreme_values", ref, hist, cluster_thresh=1e6, by=["site"]).adjust(sim, scen=sim).exceptAll(sim).isEmpty()


def test_principal_components_come_back_from_files(spark, tmp_path):
    ref, hist, sim = frames(spark)
    model = A.train("principal_components", ref, hist, variables=["u", "v"], by=["site"])
    out = values(model.adjust(sim))
    r, h, s = clouds()
    t = np.array(model.table.first().trans).reshape(2, 2)
    assert np.allclose(t @ np.cov(h) @ t.T, np.cov(r))
    assert np.allclose(out, r.mean(axis=1)[:, None] + t @ (s - s.mean(axis=1)[:, None]))
    model.save(f"file://{tmp_path}/m")
    assert np.allclose(values(A.Model.load(spark, f"file://{tmp_path}/m").adjust(sim)), out)


def plain_spline(x, y, at):
    """Cubics between knots by all of their conditions at once; the third derivative goes through the second and last but one knot."""
    n = len(x) - 1
    m, b = [], []

    def row(i, t, order):
        out = np.zeros(4 * n)
        for k in range(order, 4):
            out[4 * i + k] = math.perm(k, order) * t ** (k - order)
        return out

    for i in range(n):
        m += [row(i, 0, 0), row(i, x[i + 1] - x[i], 0)]
        b += [y[i], y[i + 1]]
        if i < n - 1:
            m += [row(i, x[i + 1] - x[i], k) - row(i + 1, 0, k) for k in (1, 2)]
            b += [0, 0]
    m += [row(0, 0, 3) - row(1, 0, 3), row(n - 2, 0, 3) - row(n - 1, 0, 3)]
    c = np.linalg.solve(np.array(m), np.array(b + [0, 0]))
    out = []
    for t in at:
        t = min(max(t, x[0]), x[-1])
        i = min(max(np.searchsorted(x, t, "right") - 1, 0), n - 1)
        out.append(sum(c[4 * i + k] * (t - x[i]) ** k for k in range(4)))
    return np.array(out)


def test_cubic_mapping_equals_a_plain_spline(spark):
    rng = np.random.default_rng(5)
    r, h, s = (rng.gamma(3, k, 200) for k in (3, 2, 2.5))
    model = A.train("eqm", series(spark, r), series(spark, h), nquantiles=10, by=["site"])
    q = [plain_quantile(h, k) for k in NODES]
    af = [plain_quantile(r, k) - b for k, b in zip(NODES, q)]
    out = model.adjust(series(spark, s), interp="cubic").orderBy("time").toPandas()["scen"]
    assert np.allclose(out, s + plain_spline(np.array(q), np.array(af), s))


def test_scaling_between_months_by_a_spline(spark):
    x = 5 + np.sin(np.arange(730) / 58)
    ref, hist = series(spark, x), series(spark, x * 0)
    model = A.train("scaling", ref, hist, group="time.month", by=["site"])
    month = {r.grp: r.af for r in model.table.collect()}
    knots = np.arange(0, 14.0)
    got = model.adjust(hist, interp="cubic").orderBy("time").toPandas()["scen"].to_numpy()
    days = pd.date_range("2000-01-01", periods=730)
    at = days.month - 0.5 + days.day / days.days_in_month
    assert np.allclose(got, plain_spline(knots, np.array([month[(k - 1) % 12 + 1] for k in range(14)]), at))


# what goes round the methods

def test_series_that_count_together(spark):
    rng = np.random.default_rng(6)
    members = [rng.random(100) + k for k in range(3)]
    hist = members[0]
    one = functools_union([series(spark, x, start="2000-01-01").withColumn("member", F.lit(k)) for k, x in enumerate(members)])
    ref = functools_union([series(spark, x + 2, start="2000-01-01").withColumn("member", F.lit(k)) for k, x in enumerate(members)])
    for method in ("eqm", "qdm", "scaling"):
        options = {} if method == "scaling" else {"nquantiles": 10}
        model = A.train(method, ref, one, group=Grouper("time", add_dims=("member",)), by=["site", "member"], **options)
        assert model.table.count() == 1 and "member" not in model.table.columns
        out = model.adjust(one)
        assert out.count() == 300 and out.agg(F.max(F.abs(F.col("scen") - F.col("value") - 2))).first()[0] < 1e-9
    with provenance.options(extra_output=True):
        ranks = A.train("qdm", ref, one, group=Grouper("time", add_dims=("member",)), by=["site", "member"]).adjust(one)
    whole = np.concatenate(members)
    got = ranks.orderBy("member", "time").toPandas()["sim_q"]
    assert np.allclose(got, plain_rank(list(whole))) and len(hist) == 100
    with pytest.raises(ValueError):
        A.train("eqm", ref, one, group=Grouper("time", add_dims=("model",)), by=["site", "member"])


def functools_union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_options_units_and_history(spark):
    hist = provenance.attach(series(spark, np.arange(50.0)), "value", units="degC", standard_name="air_temperature")
    ref = provenance.attach(series(spark, np.arange(50.0) + 274.15), "value", units="K")
    model = A.train("eqm", ref, hist, by=["site"])
    out = model.adjust(hist, interp="linear")
    assert set(out.columns) == {"site", "time", "value", "scen"}
    meta = provenance.attributes(out, "scen")
    assert meta["units"] == "K" and meta["bias_adjustment"].startswith("eqm(") and "adjust(interp='linear')" in meta["history"]
    assert np.allclose(out.orderBy("time").toPandas()["scen"], np.arange(50.0) + 274.15)
    with provenance.options(extra_output=True):
        assert "af" in model.adjust(hist).columns
    with provenance.options(as_dataset=True, extra_output=True):
        assert set(model.adjust(hist).columns) == {"site", "time", "af", "scen"}
    with pytest.raises(ValueError, match="units"):
        A.train("eqm", ref, series(spark, [1, 2]), by=["site"])
    with pytest.raises(ValueError, match="columns"):
        A.train("eqm", ref, hist, by=["place"])
    with pytest.raises(ValueError, match="number"):
        A.train("eqm", ref, hist.withColumn("value", F.lit("x")), by=["site"])
    wet = provenance.attach(series(spark, np.arange(50.0)), "value", units="mm/d")
    assert A.train("loci", wet, wet, thresh="10 mm/d", by=["site"]).params["thresh"] == 10.0


def test_functions_of_ones_own(spark):
    df = series(spark, np.arange(90.0))
    assert {r.out for r in mapping.apply(df, F.max("value"), "time.month", ["site"]).collect()} == {30.0, 59.0, 89.0}
    assert mapping.apply(df, {"low": F.min("value"), "high": F.max("value")}, by=["site"]).first()[2:] == (0.0, 89.0)
    ranked = mapping.apply(df, lambda pdf: pdf[["time", "main"]].assign(value=pdf["value"].rank()), Grouper("time.dayofyear", 3), ["site"], "time date, value double", main_only=True)
    assert ranked.count() == 90 and ranked.where("value = 2").count() == 89
    with pytest.raises(ValueError):
        mapping.apply(df, lambda pdf: pdf)

    @mapping.map_blocks("site string, gap double", by=["site"])
    def gap(ref, hist, factor):
        return pd.DataFrame({"site": ref["site"].head(1), "gap": factor * (ref["value"].mean() - hist["value"].mean())})

    assert gap(ref=df, hist=series(spark, np.arange(90.0) + 1), params={"factor": 2.0}).first().gap == -2.0

    @mapping.map_groups("site string, grp int, n long", by=["site"])
    def size(ref, hist):
        return pd.DataFrame({"site": ref["site"].head(1), "grp": ref["grp"].head(1), "n": [len(ref) + len(hist)]})

    assert {r.grp: r.n for r in size(ref=df, hist=df, group="time.month").collect()} == {1: 62, 2: 58, 3: 60}
    assert mapping.takes_group(lambda df, group: group)(None, group="time.month", window=3) == Grouper("time.month", 3)
    with pytest.raises(ValueError):
        mapping.takes_group(lambda df, group: group, ["time"])(None, group="time.month")


def test_distributions():
    u = (np.arange(4000) + 0.5) / 4000
    samples = {
        "gamma": (3.0, 2.0, 1.5, np.random.default_rng(1).gamma(3.0, 1.5, 6000) + 2.0),
        "weibull_min": (1.7, 1.0, 2.0, 1.0 + 2.0 * (-np.log(1 - u)) ** (1 / 1.7)),
        "fisk": (5.0, 1.0, 2.0, 1.0 + 2.0 * (u / (1 - u)) ** (1 / 5.0)),
        "genextreme": (0.1, 10.0, 3.0, np.array([K.gev_ppf(p, 0.1, 10.0, 3.0) for p in u])),
        "genpareto": (0.1, 0.0, 2.0, K.gpd_ppf(u, 0.1, 2.0)),
    }
    for dist, (c, loc, scale, x) in samples.items():
        found = K.fit(x, dist, "ML", 0.0 if dist == "genpareto" else None)
        assert np.allclose(found, (c, loc, scale), rtol=0.15, atol=0.15), dist
        log = lambda c, loc, scale: K.DENSITIES[dist]((x - loc) / scale, c).sum() - len(x) * math.log(scale)  # noqa: B023, E731
        assert log(*found) >= log(c, loc, scale) - 1e-6, dist
        m, v, skew = K.standard_moments(dist, (mm := K.fit(x, dist, "MM"))[0])
        assert np.allclose((mm[1] + mm[2] * m, mm[2] ** 2 * v), (x.mean(), x.var()), rtol=1e-6), dist
        assert np.isclose(skew, ((x - x.mean()) ** 3).mean() / x.std() ** 3, rtol=1e-4), dist
        assert np.isfinite(K.fit(x, dist, "APP")).all()
    assert np.allclose(K.fit(samples["genpareto"][3], "genpareto", "PWM"), (0.1, 0, 2), atol=0.05)
    with pytest.raises(NotImplementedError):
        K.fit(samples["gamma"][3], "gamma", "PWM")
    with pytest.raises(ValueError):
        K.fit(u, "none")
    assert np.isnan(K.fit(np.ones(9), "gamma")).all()


def test_fits_of_groups(spark):
    df = generators.precipitation(spark, 400, sites=2).where("value > 0")
    rows = S.fitted(df, "gamma", by=["site"], loc=0.0).collect()
    assert len(rows) == 2 and all(r["loc"] == 0 and r["scale"] > 0 for r in rows)
    assert S.fitted(df.where("value < 0"), "gamma", by=["site"]).count() == 0
    known = spark.createDataFrame([(1, None), (2, 5.0), (3, 6.0), (4, None)], "time int, value double").agg(S.first_known("value").alias("a"), S.last_known("value").alias("b")).first()
    assert known[:] == (5.0, 6.0)


def test_periods_of_other_lengths(spark):
    df = series(spark, np.arange(366 + 365), start="2000-01-01")
    months = T.stack_periods(df, 3, 3, by=["site"], freq="MS")
    assert [str(r.period) for r in months.select("period").distinct().orderBy("period").collect()] == [f"{y}-{m:02}-01" for y in (2000, 2001) for m in (1, 4, 7, 10)]
    winters = T.stack_periods(df, 1, 1, by=["site"], freq="QS-DEC").select("period").distinct().orderBy("period").collect()
    assert [str(r.period) for r in winters] == ["2000-03-01", "2000-06-01", "2000-09-01", "2000-12-01", "2001-03-01", "2001-06-01", "2001-09-01"]
    padded = T.stack_periods(df, 1, 1, by=["site"], freq="YS", pad_value=-1.0, start="1970-01-01")
    assert padded.groupBy("period").count().select("count").distinct().first()[0] == 366 and padded.where("value = -1").count() == 1
    assert T.unstack_periods(padded.where("value >= 0"), 1, 1, ["site"]).exceptAll(df).isEmpty()
    # a record that begins within a year: windows of whole strides from its base period on
    late = series(spark, np.arange(365 * 8), start="2000-06-01")
    assert [str(r.period) for r in T.stack_periods(late, 3, 3, by=["site"]).select("period").distinct().orderBy("period").collect()] == ["2003-01-01"]
    assert T.unstack_periods(T.stack_periods(df, 3, 1, by=["site"], freq="MS"), 3, 1, ["site"], freq="MS").count() == df.count()
    with pytest.raises(ValueError):
        T.stack_periods(df, 1, freq="YS", align_days=True)


def test_units_and_offsets(spark):
    assert units.cf_attributes("mm/d") == {"units": "mm d-1"}
    assert units.cf_attributes("degC")["units_metadata"] == "temperature: unknown" and units.cf_attributes("delta_degC")["units_metadata"] == "temperature: difference"
    df = spark.createDataFrame([(2.0,)], "x double")
    x, unit = units.product(F.col("x"), "mm/d", "3 d")
    assert df.select(x).first()[0] == 6.0 and units.parse(unit).powers == (1, 0, 0, 0)
    assert df.select(units.product(F.col("x"), "m/s", "10 s", "km")[0]).first()[0] == pytest.approx(0.02)
    a, b = provenance.attach(df, "x", units="K"), provenance.attach(df, "x", units="degC")
    assert [f.first()[0] for f in units.harmonise([a, b], "x")] == pytest.approx([2.0, 275.15])
    assert offsets.compare("MS", "<", "QS-DEC") and offsets.compare("12MS", "==", "YS") and offsets.compare("3D", ">=", "2D")
    assert offsets.months("2QS-DEC") == (6, 2) and offsets.months("YE-MAY") == (12, 5)
    with pytest.raises(ValueError):
        offsets.months("3D")
    assert inputs.kinds(A.adjust_eqm)["sim"] is inputs.Kind.FRAME and inputs.kinds(A.train)["params"] is inputs.Kind.KEYWORDS


def test_zero_shares_and_constant_series(spark):
    """No dry values, all dry values, constant variables: NULLs, not errors."""
    wet, dry = series(spark, [5.0, 6.0, 7.0]), series(spark, [0.0, 0.0, 0.0])
    for ref, sim in ((wet, wet), (wet, dry), (dry, wet), (dry, dry)):
        out, shares = P.adapt_freq(ref, sim, "time", 1.0, ["site"])
        assert len(out.collect()) == 3 and len(shares.collect()) == 1
    assert [r.value for r in P.standardize(dry, ["site"]).collect()] == [None] * 3
    assert P.standardize(wet, value="value").select("mean").first()[0] == 6.0
    given = spark.createDataFrame([("a", 1.0, 2.0)], "site string, mean double, std double")
    assert sorted(r.value for r in P.standardize(wet, ["site"], moments=given).collect()) == [2.0, 2.5, 3.0]
    assert P.escore(dry, wet, ["value"], ["site"], scale=True).first().escore is None
    assert D.polynomial(wet, degree=4, by=["site"]).where("trend IS NOT NULL").count() == 0


def test_frequency_adaptation_by_given_shares(spark):
    rng = np.random.default_rng(10)
    ref, sim = (series(spark, [0.0 if x < share else 1 + x for x in rng.random(300)]) for share in (0.2, 0.5))
    out, shares = P.adapt_freq(ref, sim, "time", 0.5, ["site"])
    again, _ = P.adapt_freq(None, sim, "time", 0.5, ["site"], shares=shares.select("site", "grp", "P0_ref", "P0_hist", "pth"))
    assert again.exceptAll(out).isEmpty() and abs(out.where("value <= 0.5").count() - ref.where("value <= 0.5").count()) <= 2
    with pytest.raises(ValueError):
        P.adapt_freq(None, sim, "time", 0.5, ["site"])
    with pytest.raises(ValueError):
        P.adapt_freq(None, sim, "time", 0.5, ["site"], shares=shares.drop("pth"))


def test_energy_score_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y = rng.random((2, 60)), rng.random((2, 45)) + 0.2
    a, b = wide(spark, x), wide(spark, y)
    want = K.energy_score(x, y)
    for points in (P.POINTS, 8):
        monkeypatch.setattr(P, "POINTS", points)
        for by in (["site"], []):
            assert np.isclose(P.escore(a, b, ["u", "v"], by).first().escore, want)
    assert np.isclose(P.escore(a, b, ["u", "v"], n=20).first().escore, K.energy_score(x, y, 20))


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(8)
    z = rng.random((5, 40))
    z[1, 3:9] = z[3, 30:] = np.nan
    df = spark.createDataFrame([(i, d.date(), None if np.isnan(v) else float(v)) for i in range(5) for d, v in zip(DAYS, z[i])], "site int, time date, value double")
    d = z - np.nanmean(z, axis=0)
    want = {}
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(d[i]) & ~np.isnan(d[j])
            want[i, j] = np.corrcoef(pd.Series(d[i][both]).rank(), pd.Series(d[j][both]).rank())[0, 1]
    for block in (64, 2):
        got = {(r.a, r.b): r.corr for r in R.pairwise_spearman(df, block=block).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    sites = spark.createDataFrame([(i, float(i), 45.0) for i in range(5)], "site int, lon double, lat double")
    edges = R.spatial_correlogram(df, sites, [0.0, 100.0, 200.0]).orderBy("distance").collect()
    assert [r.distance for r in edges] == [50.0, 150.0] and np.isclose(edges[0].corr, np.mean([want[i, i + 1] for i in range(4)]))


def test_filter_by_wavelengths_and_a_mask_of_ones_own(spark):
    grid = spark.createDataFrame([(y, x, float((7 * y + 3 * x) % 5)) for y in range(6) for x in range(8)], "y int, x int, value double")
    one = {(r.y, r.x): r.value for r in P.spectral_filter(grid, (6, 8), 0.2, 0.8).collect()}
    two = {(r.y, r.x): r.value for r in P.spectral_filter(grid, (6, 8), lam_long=100.0, lam_short=25.0, delta=10.0).collect()}
    assert all(np.isclose(one[k], two[k]) for k in one)
    same = {(r.y, r.x): r.value for r in P.spectral_filter(grid, (6, 8), 0.2, 0.8, mask=lambda a, low, high: F.lit(1.0)).collect()}
    assert all(np.isclose(same[r.y, r.x], r.value) for r in grid.collect())
    with pytest.raises(ValueError):
        P.spectral_filter(grid, (6, 8), lam_long=100.0, high=0.8)
    spacing = P.grid_spacing(grid.select(F.col("x").cast("double").alias("lon")), "lon").first().delta
    assert np.isclose(spacing, 111.2)


def test_tables_by_day_of_unlike_length(spark):
    short = spark.createDataFrame([(d, float(d)) for d in range(1, 361)], "grp int, value double")
    long = spark.createDataFrame([(d, float(d)) for d in range(1, 367)], "grp int, value double")
    one, two = longest_days(short, long)
    assert one.count() == two.count() == 366 and np.isclose(one.where("grp = 366").first().value, 360.0)
    out = broadcast_groups(series(spark, range(366)), one, "time.dayofyear", "value")
    assert out.where("factor IS NULL").count() == 0


def test_loess_by_group_and_gaps(spark):
    rng = np.random.default_rng(9)
    x = rng.random(120)
    df = series(spark, [None if i == 50 else v for i, v in enumerate(x)])
    assert D.local_regression(df, ["site"]).where("trend IS NULL").count() == 1
    assert D.local_regression(df, ["site"], skipna=False).where("trend IS NULL").count() == 120
    got = D.local_regression(df, ["site"], f=0.5, d=1, group="time.month").where("month(time) = 3").orderBy("time").toPandas()["trend"]
    assert np.allclose(got, K.loess(np.arange(31.0), x[60:91], f=0.5, niter=1, d=1))


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, f in QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.columns, name
