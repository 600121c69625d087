"""Known values, identities and error contracts of the library."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import calendars, offsets, provenance, units
from tidemark.functions import kernels as K
from tidemark.operators import adjust as A
from tidemark.operators import detrend as D
from tidemark.operators import measures as M
from tidemark.operators import multivariate as V
from tidemark.operators import periods as T
from tidemark.operators import processing as P
from tidemark.operators import properties as R
from tidemark.operators import stats as S
from tidemark.operators.grouping import Grouper, grouped, time_blocks
from tidemark.plans import contract  # noqa: F401  registers its queries
from tidemark.plans.registry import QUERIES
from tidemark.sources import series
from tidemark.streaming.transform import adjust_stream


def frame(spark, values, start="2000-01-01", site="a", name="value", freq="D"):
    time = pd.date_range(start, periods=len(values), freq=freq).date
    return spark.createDataFrame([Row(site=site, time=t, **{name: None if v is None else float(v)}) for t, v in zip(time, values)], f"site string, time date, {name} double")


def one(df, column):
    return df.first()[column]


@pytest.mark.parametrize(("d", "f", "weights", "niter", "equal", "middle", "last"), [(0, 0.2, "tricube", 1, False, -0.0698081, -0.3623449), (0, 0.31, "tricube", 2, True, -0.0052623, -0.1453554), (1, 0.2, "tricube", 3, True, -0.0555941, -0.9219777), (1, 0.2, "tricube", 4, False, -0.0691396, -0.9155697), (1, 0.4, "gaussian", 2, False, 0.00287228, -0.4469015)])
def test_loess(d, f, weights, niter, equal, middle, last):
    x = np.linspace(0, 1, 100)
    got = K.loess(x, np.sin(10 * np.pi * x), f=f, niter=niter, d=d, weights=weights, equal_spacing=equal)
    assert np.isclose(got[50], middle) and np.isclose(got[-1], last)


def test_energy_score(spark):
    x = np.array([[1, 4, 3, 6, 4, 7], [5, 8, 4, 5, 3, 7]], float)
    y = np.array([[6, 6, 3, 8, 5, 7], [3, 7, 3, 6, 4, 3]], float)
    assert np.isclose(K.energy_score(x, y), 1.90018550338863)
    clouds = [spark.createDataFrame([Row(time=i, u=float(a), v=float(b)) for i, (a, b) in enumerate(z.T)]) for z in (x, y)]
    assert np.isclose(one(P.escore(*clouds, ["u", "v"]), "escore"), 1.90018550338863)


def test_circular_bias(spark):
    df = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(zip([1, 1, 1, 2, 365, 300], [2, 365, 300, 1, 1, 1]))], "i int, sim int, ref int")
    out = M.compare("circular_bias", df.select("i", F.col("sim").alias("x")), df.select("i", F.col("ref").alias("x")), ["i"], "x")
    assert [r.circular_bias for r in out.orderBy("i").collect()] == [1, 1, 66, -1, -1, -66]


def test_reordering_with_a_window(spark):
    days = [f"{y}-01-{d:02}" for y in (2000, 2001) for d in range(1, 5)]
    ref, sim = (spark.createDataFrame(list(zip(days, map(float, v))), "time string, value double").withColumn("time", F.to_date("time")) for v in (range(1, 9), range(8, 0, -1)))
    out = P.reordering(ref, sim, Grouper("time.dayofyear", 3))
    assert [r.value for r in out.orderBy("time").collect()] == [3, 3, 2, 2, 7, 7, 6, 6]


def test_group_index(spark):
    df = spark.createDataFrame([("2000-03-31",)], "t string").select(F.to_date("t").alias("t"))
    assert one(df.select(C.group_index(F.col("t"), "time.month").alias("x")), "x") == 3.5
    assert np.isclose(one(df.select(C.group_index(F.col("t"), "time.season").alias("x")), "x"), 0.82786885)
    with pytest.raises(ValueError):
        Grouper("time", 3)
    with pytest.raises(ValueError):
        Grouper("time.hour")


def test_lookups(spark):
    xq, yq = [205.0 + i for i in range(25)], [2 + i / 10 for i in range(25)]
    df = spark.createDataFrame([(214.5, xq, yq), (239.5, xq, yq), (199.5, xq, yq), (None, xq, yq)], "x double, xq array<double>, yq array<double>")
    near = [r[0] for r in df.select(C.nearest(F.col("x"), F.col("xq"), F.col("yq"))).collect()]
    assert np.allclose(near[:3], [2.9, 4.4, 2.0]) and near[3] is None
    lin = [r[0] for r in df.select(C.linear(F.col("x"), F.col("xq"), F.col("yq"))).collect()]
    assert np.allclose(lin[:3], [2.95, 4.4, 2.0])
    assert [r[0] for r in df.select(C.linear(F.col("x"), F.col("xq"), F.col("yq"), constant=False)).collect()][1:] == [None] * 3


def test_cubic_mapping(spark):
    rng = np.random.default_rng(8)
    hist = frame(spark, rng.random(3000) * 4)
    ref = hist.withColumn("value", F.col("value") + 0.1 * F.pow("value", F.lit(3)))
    for group in ("time", "time.month"):
        model = A.train("eqm", ref, hist, nquantiles=30, group=group, by=["site"])
        both = model.adjust(hist, interp="cubic").select("time", "scen").join(ref.select("time", "value"), "time")
        assert one(both.agg(F.percentile(F.abs(F.col("scen") - F.col("value")), 0.9).alias("x")), "x") < (0.02 if group == "time" else 0.1)


def test_calendars_and_offsets(spark):
    day = spark.createDataFrame([(90,)], "tidx int")
    for calendar, season in (("360_day", 0.8444444444444444), ("noleap", 0.8305936073059361)):
        assert np.isclose(one(calendars.with_parts(day, calendar).select(calendars.part_index("time.season", calendar).alias("x")), "x"), season)
    days = calendars.with_parts(spark.range(0, 366).select(F.col("id").cast("int").alias("tidx")), "noleap").orderBy("tidx").collect()
    assert [(r.year, r.month, r.dom, r.doy) for r in (days[58], days[59], days[365])] == [(2000, 2, 28, 59), (2000, 3, 1, 60), (2001, 1, 1, 1)]
    assert calendars.max_doy("366_day") == 366
    assert offsets.parse("2W") == (14, "D", True, None) and offsets.parse("QS-DEC") == (1, "Q", True, "DEC") and offsets.parse("YE") == (1, "Y", False, "DEC")
    assert offsets.construct(3, "M", True, None) == "3MS" and offsets.construct(1, "Q", True, "DEC") == "QS-DEC"
    assert offsets.length("YS") > offsets.length("11MS")
    assert offsets.begins_period(12, "QS-DEC") and not offsets.begins_period(1, "QS-DEC") and offsets.begins_period(1, "YE")
    with pytest.raises(ValueError):
        offsets.parse("3X")


def test_single_value_has_no_rank(spark):
    assert one(S.percent_rank(frame(spark, [3.0]), "value", ["site"], "r"), "r") is None
    got = [r.r for r in S.percent_rank(frame(spark, [1, 2, 2, None, 4]), "value", ["site"], "r").orderBy("time").collect()]
    assert np.allclose(K.rank_share(np.array([1, 2, 2, np.nan, 4.0]))[[0, 1, 2, 4]], [got[i] for i in (0, 1, 2, 4)]) and got[3] is None


def test_spells(spark):
    df = frame(spark, [0] * 365 + [40] * 365)
    assert one(R.spell_length_distribution(df, thresh=30, op=">", stat="max", window=1, by=["site"], resample_before_rl=False), "spell") == 365
    runs = R.spell_length_distribution(frame(spark, [0] * 365 + [40] * 365, start="2001-01-01"), thresh=30, op=">", stat="mean", stat_resample="max", by=["site"])
    assert one(runs, "spell") == 182.5
    assert one(R.spell_length_distribution(frame(spark, [0] * 365 + [40] * 365, start="2001-01-01"), thresh=30, op=">", stat="max", stat_resample="mean", by=["site"]), "spell") == 365


def test_additive_space(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1e-5, 1.0, math.exp(10))], "x double")
    got = [r[0] for r in df.select(C.to_additive(F.col("x"), 0.0)).collect()]
    assert got[0] == -math.inf and np.allclose(got[1:], [-11.512925, 0, 10])
    back = [r[0] for r in df.select(C.from_additive(C.to_additive(F.col("x"), 0.0), 0.0)).collect()]
    assert np.allclose(back, [0, 1e-5, 1, math.exp(10)])
    share = spark.createDataFrame([(x,) for x in (0.0, 0.25, 1.0)], "x double")
    assert [r[0] for r in share.select(C.to_additive(F.col("x"), 0.0, 1.0, "logit")).collect()][::2] == [-math.inf, math.inf]
    assert all(math.isfinite(r[0]) for r in share.select(C.to_additive(F.col("x"), 0.0, 1.0, "logit", "permissive")).collect())
    with pytest.raises(ValueError):
        C.to_additive(F.col("x"), 0.0, trans="logit")


def gammas(spark, n=2000):
    rng = np.random.default_rng(7)
    u = lambda k, s: np.sort(rng.gamma(k, s, 200_000))[((np.arange(n) + 0.5) / n * 200_000).astype(int)][rng.permutation(n)]
    return [frame(spark, u(*p)) for p in ((4, 7.5), (8.15, 3.68), (16, 2.63))]


def test_quantile_delta_mapping_moments(spark):
    ref, hist, sim = gammas(spark)
    out = A.train("qdm", ref, hist, nquantiles=50, kind="*", by=["site"]).adjust(sim).agg(F.avg("scen"), F.stddev_pop("scen")).first()
    assert abs(out[0] - 41.5) < 0.5 and abs(out[1] - 16.7) < 1.5


def test_detrended_mapping_moments(spark):
    ref, hist, sim = gammas(spark)
    out = A.train("dqm", ref, hist, nquantiles=50, kind="*", by=["site"]).adjust(sim).agg(F.avg("scen"), F.stddev_pop("scen")).first()
    assert abs(out[0] - 41.6) < 0.7 and abs(out[1] - 15.0) < 1.5


def test_mapping_brings_hist_to_ref(spark):
    rng = np.random.default_rng(1)
    u = rng.random(3000)
    hist, ref = frame(spark, 10 + u), frame(spark, 12 + 2 * u)
    for method in ("eqm", "qdm"):
        model = A.train(method, ref, hist, nquantiles=50, by=["site"])
        both = model.adjust(hist, interp="linear").select("time", "scen").join(ref, "time")
        assert one(both.agg(F.max(F.abs(F.col("scen") - F.col("value"))).alias("x")), "x") < 0.1


def test_models_come_back_from_files(spark, tmp_path):
    ref, hist, sim = gammas(spark, 400)
    model = A.train("eqm", ref, hist, group="time.month", by=["site"])
    model.save(f"file://{tmp_path}/m")
    again = A.Model.load(spark, f"file://{tmp_path}/m")
    assert again.params == model.params
    a, b = (sorted(r.scen for r in m.adjust(sim).collect()) for m in (model, again))
    assert a == b


def test_tail_factor_keeps_extremes(spark):
    rng = np.random.default_rng(3)
    ref, hist = frame(spark, rng.random(1000) * 20), frame(spark, rng.random(1000) * 10)
    sim = frame(spark, [300.0, *(rng.random(999) * 10)])
    for method in ("eqm", "qdm", "dqm"):
        out = A.train(method, ref, hist, kind="*", by=["site"], max_tail_factor=10).adjust(sim)
        assert out.orderBy("time").first().scen == 300.0


def test_frequency_adaptation(spark):
    rng = np.random.default_rng(4)
    ref = [x / 20 if x < 10 else x for x in rng.integers(0, 100, 3000)]
    sim = [x / 20 if x < 20 else x for x in rng.integers(0, 100, 3000)]
    out, shares = P.adapt_freq(frame(spark, ref), frame(spark, sim), "time", 1.0, ["site"])
    share = lambda df: one(df.agg(F.avg((F.col("value") <= 1.0).cast("double")).alias("x")), "x")
    assert abs(share(out) - share(frame(spark, ref))) < 0.01
    row = shares.first()
    assert np.isclose(row.dP0, (row.P0_hist - row.P0_ref) / row.P0_hist)
    assert A.train("eqm", frame(spark, ref), frame(spark, sim), by=["site"], adapt_freq_thresh=1.0).adjust(frame(spark, sim)).count() == 3000


def test_jitter_ranges(spark):
    df = P.jitter(frame(spark, [0, 0.5, 5, 99, 100, None]), lower=1.0, upper=99.0, maximum=100.0)
    got = [r.value for r in df.orderBy("time").collect()]
    assert 0 < got[0] < 1 and 0 < got[1] < 1 and got[2] == 5 and 99 <= got[3] < 100 and 99 <= got[4] < 100 and got[5] is None
    with pytest.raises(ValueError):
        P.jitter(df, upper=1.0)


def test_round_trips(spark):
    df = frame(spark, np.sin(np.arange(400) / 9) + 3)
    for trended in (D.mean(df, "time.month", ["site"]), D.polynomial(df, degree=1, by=["site"]), D.polynomial(df, degree=4, by=["site"]), D.rolling_mean(df, 7, min_periods=1, by=["site"]), D.rolling_mean(df, 3, weights=[1, 2, 1], by=["site"]), D.local_regression(df, ["site"])):
        for kind in "+*":
            back = D.retrended(D.detrended(trended, kind), kind).where("trend IS NOT NULL").select("time", F.col("value").alias("x")).join(df, "time")
            assert one(back.agg(F.max(F.abs(F.col("x") - F.col("value"))).alias("d")), "d") < 1e-9
    assert [D.detrended(D.none(df, k), k).exceptAll(D.none(df, k)).count() for k in "+*"] == [0, 0]
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "time int, b double, a double")
    assert sorted(map(tuple, P.unstack_variables(P.stack_variables(wide, ["a", "b"], ["time"]), ["a", "b"], ["time"]).collect())) == [(1, 3.0, 2.0), (2, 5.0, 4.0)]


def test_degree_four_is_exact(spark):
    t = np.arange(200.0)
    df = D.polynomial(frame(spark, 1 + t - 2e-2 * t**2 + 1e-4 * t**3 - 1e-7 * t**4), degree=4, by=["site"])
    assert one(df.agg(F.max(F.abs(F.col("trend") - F.col("value"))).alias("d")), "d") < 1e-6


def test_periods(spark):
    df = frame(spark, range(365 * 8 + 2), start="2001-01-01")
    stacked = T.stack_periods(df, 5, 1, by=["site"])
    assert stacked.select("period").distinct().count() == 4
    assert T.unstack_periods(stacked, 5, 1, ["site"]).count() == df.count()
    with pytest.raises(ValueError):
        T.stack_periods(df, 2, 3)
    with pytest.raises(NotImplementedError):
        T.unstack_periods(stacked, 4, 1)


def test_blocks(spark):
    df = frame(spark, range(365), start="2001-01-01")
    assert time_blocks(df, "5D", 3, ["site"]).groupBy("block").count().agg(F.min("count"), F.max("count")).first()[:] == (15, 15)
    with pytest.raises(ValueError):
        time_blocks(df, "5D", 2)
    assert grouped(df, Grouper("time.dayofyear", 3), ["site"]).count() == 365 * 3 - 2


def test_principal_components_match_covariances(spark):
    rng = np.random.default_rng(5)
    n = 2000
    a, b = rng.multivariate_normal([10, 3], [[1, 0.5], [0.5, 4]], n), rng.multivariate_normal([4, 5], [[4, -1], [-1, 9]], n)
    days = pd.date_range("2000-01-01", periods=n).date
    ref, hist = (spark.createDataFrame([(d, float(x), float(y)) for d, (x, y) in zip(days, z)], "time date, u double, v double") for z in (a, b))
    for orientation in ("simple", "full"):
        out = V.principal_components(ref, hist, hist, ["u", "v"], best_orientation=orientation).toPandas()
        assert np.allclose(np.cov(out[["u", "v"]].T), np.cov(a.T)) and np.allclose(out[["u", "v"]].mean(), a.mean(axis=0))


def test_queries_turn_as_often_as_the_default(spark, monkeypatch):
    turned, rotations = [], K.rotations
    monkeypatch.setattr(K, "rotations", lambda m, n, seed: turned.append(n) or rotations(m, n, seed))
    for name in ("npdf_transform", "mbcn", "mbcn_5d"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert turned == [20, 20, 20]


def test_multivariate_methods_bring_means_near(spark):
    rng = np.random.default_rng(6)
    n = 600
    a, b = rng.multivariate_normal([10, 3], [[1, 0.8], [0.8, 1]], n), rng.multivariate_normal([12, 5], [[2, -0.5], [-0.5, 1]], n)
    days = pd.date_range("2000-01-01", periods=n).date
    ref, hist = (spark.createDataFrame([(d, float(x), float(y)) for d, (x, y) in zip(days, z)], "time date, u double, v double") for z in (a, b))
    for f in (V.npdf_transform, V.mbcn, V.dotc):
        out = f(ref, hist, hist, ["u", "v"]).toPandas()
        assert np.allclose(out[["u", "v"]].mean(), a.mean(axis=0), atol=0.3), f.__name__
        assert abs(np.corrcoef(out[["u", "v"]].T)[0, 1] - 0.8) < 0.2, f.__name__
    moved = V.otc(ref, hist, ["u", "v"]).toPandas()
    assert np.allclose(moved[["u", "v"]].mean(), a.mean(axis=0), atol=0.2)
    with pytest.raises(ValueError):
        V.mbcn(ref, hist, hist, ["u", "v"], group="time.month")
    with pytest.raises(ValueError):
        V.dotc(ref, hist, hist, ["u", "v"], cov_factor="cholesky", kinds={"u": "*"})


def test_transport_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        n = rng.integers(2, 6)
        cost = rng.random((n, n))
        best = min(sum(cost[i, s[i]] for i in range(n)) for s in itertools.permutations(range(n)))
        assert abs((K.transport(cost, np.ones(n), np.ones(n)) * cost).sum() - best) < 1e-9


def test_extreme_fits():
    u = np.random.default_rng(0).random(4000)
    assert np.allclose(K.fit_gpd(K.gpd_ppf(u, 0.15, 2.0)), (0.15, 2.0), atol=0.08)
    x = np.array([K.gev_ppf(p, -0.1, 10, 3) for p in u])
    for method in ("ML", "PWM"):
        assert np.allclose(K.fit_gev(x, method), (-0.1, 10, 3), atol=0.15)
    assert np.isclose(K.t_pvalue(2.228138852, 10), 0.05)
    knots = np.array([0, 1, 2.5, 3, 4])
    assert np.allclose(K.cubic_spline(knots, knots**3)(np.array([0.5, 2, 3.5])), [0.125, 8, 42.875])
    turn = K.rotations(3, 2)[0]
    assert np.allclose(turn @ turn.T, np.eye(3))


def test_units(spark):
    assert units.conversion("kg m-2 s-1", "mm/d") == pytest.approx((86400.0, 0.0))
    assert units.conversion("degC", "K") == (1.0, 273.15)
    assert units.quantity("32 degF", "degC") == pytest.approx(0.0)
    assert units.parse("m^3/kg").powers == (3, -1, 0, 0)
    with pytest.raises(ValueError):
        units.conversion("K", "mm")
    with pytest.raises(ValueError):
        units.harmonised(["K", None])
    assert units.sampling(frame(spark, range(5)), ["site"]) == (1, "d")


def test_metadata_and_options(spark):
    df = provenance.record(provenance.attach(frame(spark, [1]), "value", units="K"), "value", provenance.call("mean", group="time"))
    assert provenance.attributes(df, "value")["units"] == "K" and "mean(group='time')" in provenance.attributes(df, "value")["history"]
    assert provenance.attributes(provenance.copied(df.withColumn("value", F.col("value") + 1), df), "value")["units"] == "K"
    with provenance.options(extra_output=True):
        assert provenance.option("extra_output")
    assert not provenance.option("extra_output")
    with pytest.raises(ValueError), provenance.options(other=True):
        pass


@pytest.mark.parametrize("format", series.FORMATS)
def test_sources(spark, tmp_path, format):
    df = frame(spark, [1.0, float("nan"), 3.0])
    own = series.SeriesFrame(df, ("site",), units={"value": "degC"})
    series.write(own, f"file://{tmp_path}/x", format)
    got = series.read(spark, f"file://{tmp_path}/x", format, schema="site string, time date, value double" if format in ("csv", "json") else None, by=["site"], units={"value": "degC"})
    assert [r.value for r in got.converted("value", "K").df.orderBy("time").collect()] == [274.15, None, 276.15]
    series.check(own, got, same_times=True, same_size=True)
    with pytest.raises(ValueError):
        series.check(own, series.SeriesFrame(df.limit(1), ("site",), units={"value": "K"}), same_times=True)
    with pytest.raises(ValueError):
        series.SeriesFrame(df, ("place",))


def test_stream(spark, tmp_path):
    ref, hist, sim = gammas(spark, 300)
    model = A.train("eqm", ref, hist, by=["site"])
    sim.write.parquet(f"file://{tmp_path}/sim")
    stream = spark.readStream.schema(sim.schema).parquet(f"file://{tmp_path}/sim")
    q = adjust_stream(model, stream).writeStream.format("memory").queryName("adjusted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.scen for r in spark.table("adjusted").collect()) == sorted(r.scen for r in model.adjust(sim).collect())
    with pytest.raises(ValueError):
        adjust_stream(A.train("qdm", ref, hist, by=["site"]), stream)


def test_methods_of_ones_own(spark):
    A.register("shift", lambda ref, hist, **p: A.Model("shift", p, ref.agg(F.avg("value").alias("m"))), lambda model, sim: sim.crossJoin(F.broadcast(model.table)).withColumn("scen", F.col("value") + F.col("m")))
    assert one(A.train("shift", frame(spark, [1, 3]), frame(spark, [1])).adjust(frame(spark, [5])), "scen") == 7
    with pytest.raises(ValueError):
        A.register("eqm", None, None)
    with pytest.raises(ValueError):
        A.train("none", None, None)
    with pytest.raises(RuntimeError):
        R.first_eof()


def test_queries_equal_their_sql(spark):
    """A few of the driver's queries against DuckDB on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("eqm_month_add_nearest", "qdm_month_add", "scaling_month_linear", "adapt_freq_time", "spell_length_month", "annual_cycle_phase", "measure_circular_bias", "window_groups", "taylor_diagram"):
        out = queries[name](spark, sf)
        columns = sorted(out.columns)
        got = sorted(map(str, (tuple(r[c] for c in columns) for r in out.collect())))
        cursor = con.execute(sql[name])
        at = [[d[0] for d in cursor.description].index(c) for c in columns]
        assert got == sorted(map(str, (tuple(r[i] for i in at) for r in cursor.fetchall()))), name
    assert entry.entry(spark).count() > 0
