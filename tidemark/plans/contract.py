"""Queries on the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import provenance
from tidemark.operators import adjust as A
from tidemark.operators import detrend as D
from tidemark.operators import measures as M
from tidemark.operators import multivariate as V
from tidemark.operators import periods as T
from tidemark.operators import processing as P
from tidemark.operators import properties as R
from tidemark.operators import stats as S
from tidemark.operators.grouping import Grouper, broadcast_groups, cyclic, grouped, time_blocks
from tidemark.plans.registry import Series, query, rounded

BY = ["site"]
N20 = "[" + ", ".join(map(repr, C.nodes(20))) + "]"
N10 = "[" + ", ".join(map(repr, C.nodes(10))) + "]"


def U(*keys: str, seed: int = 0) -> str:
    """SQL of columns.uniform()."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}')), 1, 12)) AS BIGINT) / CAST({16**12} AS DOUBLE))"


def R6(x: str) -> str:
    """SQL of rounded(): the shift takes exact ties off the edge, where two engines may round either way."""
    return f"round({x} + 3.7e-10, 6) + 0.0"


def rank_sql(source: str, value: str, keys: str, out: str = "r") -> str:
    """SQL of stats.percent_rank() without tie break, for a table without NULLs."""
    return f"""(SELECT *, mx * CASE WHEN mx > mn THEN (p - mn) / (mx - mn) END AS {out} FROM (SELECT *, min(p) OVER (PARTITION BY {keys}) AS mn, max(p) OVER (PARTITION BY {keys}) AS mx FROM
    (SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {keys}) AS p FROM {source})))"""


def full(model: A.Model, sim: DataFrame, **options) -> DataFrame:
    """adjust() with the columns that lead to scen."""
    with provenance.options(extra_output=True):
        return model.adjust(sim, **options)


# adjustments

TABLE = """hq AS (SELECT site, {g} AS grp, quantile_cont(value, {n}) AS hist_q FROM hist GROUP BY ALL),
rq AS (SELECT site, {g} AS grp, quantile_cont(value, {n}) AS ref_q FROM ref GROUP BY ALL),
model AS (SELECT site, grp, hist_q, list_transform(list_zip(hist_q, ref_q), lambda p: {c}) AS af FROM hq JOIN rq USING (site, grp))"""
NEAREST = "CASE WHEN {x} < {q}[1] THEN {y}[1] WHEN {x} > {q}[-1] THEN {y}[-1] ELSE {y}[1 + len(list_filter(list_zip({q}[1:-2], {q}[2:]), lambda p: (p[1] + p[2]) / 2 < {x}))] END"


def linear_sql(x: str, q: str, y: str) -> str:
    i = f"greatest(1, least(len(list_filter({q}, lambda k: k <= {x})), len({q}) - 1))"
    return f"CASE WHEN {x} < {q}[1] THEN {y}[1] WHEN {x} > {q}[-1] THEN {y}[-1] ELSE {y}[{i}] + ({x} - {q}[{i}]) * coalesce(({y}[{i} + 1] - {y}[{i}]) / nullif({q}[{i} + 1] - {q}[{i}], 0), 0) END"


PLANE = """pads AS (SELECT * FROM model UNION ALL SELECT site, 0, hist_q, af FROM model WHERE grp = 12 UNION ALL SELECT site, 13, hist_q, af FROM model WHERE grp = 1),
knots AS (SELECT site, grp, unnest(hist_q) AS xq, unnest(af) AS yq, generate_subscripts(hist_q, 1) AS i FROM pads),
s AS (SELECT *, month(time) AS g FROM sim),
near AS (SELECT s.site, s.time, s.value, s.g AS grp, arg_min(yq, {'d': (s.value - xq) * (s.value - xq) + (s.g - knots.grp) * (s.g - knots.grp), 'g': knots.grp, 'i': i}) AS inner_af FROM s JOIN knots ON s.site = knots.site GROUP BY ALL)"""


@query("eqm_month_add_nearest", f"""WITH {TABLE.format(g='month(time)', n=N20, c='p[2] - p[1]')}, {PLANE},
    f AS (SELECT near.*, CASE WHEN value < hist_q[1] THEN af[1] WHEN value > hist_q[-1] THEN af[-1] ELSE inner_af END AS af_ FROM near LEFT JOIN model USING (site, grp))
    SELECT site, time, {R6('af_')} AS af, {R6('value + af_')} AS scen FROM f""")
def eqm_month(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("eqm", s.ref, s.hist, nquantiles=20, kind="+", group="time.month", by=BY)
    return rounded(full(model, s.sim).select("site", "time", "af", "scen"), "af", "scen")


@query("eqm_time_mul_linear", f"""WITH {TABLE.format(g='1', n=N20, c='p[2] / nullif(p[1], 0)')},
    f AS (SELECT site, time, value, {linear_sql('value', 'hist_q', 'af')} AS af_ FROM sim LEFT JOIN model USING (site))
    SELECT site, time, {R6('af_')} AS af, {R6('value * af_')} AS scen FROM f""")
def eqm_time(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("eqm", s.ref, s.hist, nquantiles=20, kind="*", by=BY)
    return rounded(full(model, s.sim, interp="linear").select("site", "time", "af", "scen"), "af", "scen")


@query("eqm_tail_factor", f"""WITH {TABLE.format(g='1', n=N20, c='p[2] - p[1]')},
    f AS (SELECT site, time, value, hist_q[-1] AS top, {NEAREST.format(x='value', q='hist_q', y='af')} AS af_ FROM sim LEFT JOIN model USING (site))
    SELECT site, time, {R6('CASE WHEN value > 0.9 * top THEN value ELSE value + af_ END')} AS scen FROM f""")
def eqm_tail(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("eqm", s.ref, s.hist, nquantiles=20, by=BY, max_tail_factor=0.9)
    return rounded(model.adjust(s.sim).select("site", "time", "scen"), "scen")


def suppliers(spark: SparkSession, sf: str) -> list[DataFrame]:
    """ref, hist and sim with each supplier as a site: many sites with few values each."""
    value = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100000
    daily = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("site"), F.col("l_linestatus").alias("st"), F.col("l_shipdate").cast("date").alias("time")).agg(value.alias("value"))
    before = F.col("time") < F.lit("1999-01-01").cast("date")
    return [daily.where(w).select("site", "time", "value") for w in ((F.col("st") == "O") & before, (F.col("st") == "F") & before, (F.col("st") == "F") & ~before)]


@query("eqm_many_sites", f"""WITH own AS (SELECT l_suppkey AS site, l_linestatus AS st, CAST(l_shipdate AS DATE) AS time, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100000 AS value FROM lineitem GROUP BY 1, 2, 3),
    hq AS (SELECT site, quantile_cont(value, {N20}) AS hist_q FROM own WHERE st = 'F' AND time < DATE '1999-01-01' GROUP BY ALL), rq AS (SELECT site, quantile_cont(value, {N20}) AS ref_q FROM own WHERE st = 'O' AND time < DATE '1999-01-01' GROUP BY ALL),
    model AS (SELECT site, hist_q, list_transform(list_zip(hist_q, ref_q), lambda p: p[2] - p[1]) AS af FROM hq JOIN rq USING (site)),
    f AS (SELECT site, time, value, {NEAREST.format(x='value', q='hist_q', y='af')} AS af_ FROM (SELECT site, time, value FROM own WHERE st = 'F' AND time >= DATE '1999-01-01') LEFT JOIN model USING (site))
    SELECT site, time, {R6('value + af_')} AS scen FROM f""")
def eqm_sites(spark: SparkSession, sf: str) -> DataFrame:
    ref, hist, sim = suppliers(spark, sf)
    model = A.train("eqm", ref, hist, nquantiles=20, kind="+", by=BY)
    return rounded(model.adjust(sim).select("site", "time", "scen"), "scen")


@query("qdm_month_add", f"""WITH {TABLE.format(g='month(time)', n=N10, c='p[2] - p[1]')},
    k AS (SELECT *, month(time) AS grp FROM sim), q AS {rank_sql('k', 'value', 'site, grp', 'sim_q')},
    f AS (SELECT q.site, time, value, sim_q, CASE WHEN sim_q IS NOT NULL THEN {NEAREST.format(x='sim_q', q=f'({N10}::DOUBLE[])', y='af')} END AS af_ FROM q LEFT JOIN model USING (site, grp))
    SELECT site, time, {R6('sim_q')} AS sim_q, {R6('value + af_')} AS scen FROM f""")
def qdm_month(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("qdm", s.ref, s.hist, nquantiles=10, kind="+", group="time.month", by=BY)
    return rounded(full(model, s.sim).select("site", "time", "sim_q", "scen"), "sim_q", "scen")


@query("dqm_time_mul", f"""WITH m AS (SELECT site, quantile_cont(value, {N20}) AS h, avg(value) AS mh FROM hist GROUP BY ALL), n AS (SELECT site, quantile_cont(value, {N20}) AS r, avg(value) AS mr FROM ref GROUP BY ALL),
    model AS (SELECT site, list_transform(h, lambda q: q / mh) AS hist_q, list_transform(list_zip(h, r), lambda p: (p[2] / mr) / nullif(p[1] / mh, 0)) AS af, mr / mh AS scaling FROM m JOIN n USING (site)),
    s AS (SELECT site, time, value * scaling AS x, epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS t, hist_q, af FROM sim LEFT JOIN model USING (site)),
    a AS (SELECT site, avg(t) AS mt, avg(x) AS mx FROM s GROUP BY ALL),
    b AS (SELECT site, mt, mx, sum((t - mt) * (x - mx)) / sum((t - mt) * (t - mt)) AS slope FROM s JOIN a USING (site) GROUP BY ALL),
    d AS (SELECT s.*, mx + slope * (t - mt) AS trend FROM s JOIN b USING (site)), e AS (SELECT *, x * (1 / nullif(trend, 0)) AS z FROM d),
    f AS (SELECT *, {NEAREST.format(x='z', q='hist_q', y='af')} AS af_ FROM e)
    SELECT site, time, {R6('trend')} AS trend, {R6('z * af_ * trend')} AS scen FROM f""")
def dqm_time(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("dqm", s.ref, s.hist, nquantiles=20, kind="*", by=BY)
    return rounded(full(model, s.sim).select("site", "time", "trend", "scen"), "trend", "scen")


INDEX = "(month(time) - 0.5::DOUBLE + day(time)::DOUBLE / day(last_day(time)))"


def between_sql(table: str, value: str, out: str, source: str = "sim") -> str:
    """SQL of broadcast_groups(interp="linear") by month: a table of source rows with `out`."""
    pads = f"(SELECT site, grp, {value} AS v FROM {table} UNION ALL SELECT site, 0, {value} FROM {table} WHERE grp = 12 UNION ALL SELECT site, 13, {value} FROM {table} WHERE grp = 1)"
    return f"(SELECT s.*, CASE WHEN ix = floor(ix) THEN p0.v ELSE p0.v + (ix - floor(ix)) * (p1.v - p0.v) END AS {out} FROM (SELECT *, {INDEX} AS ix FROM {source}) s LEFT JOIN {pads} p0 ON s.site = p0.site AND p0.grp = floor(ix) LEFT JOIN {pads} p1 ON s.site = p1.site AND p1.grp = floor(ix) + 1)"


@query("scaling_month_linear", f"""WITH model AS (SELECT r.site, r.grp, m - n AS af FROM (SELECT site, month(time) AS grp, avg(value) AS m FROM ref GROUP BY ALL) r JOIN (SELECT site, month(time) AS grp, avg(value) AS n FROM hist GROUP BY ALL) h USING (site, grp))
    SELECT site, time, {R6('f')} AS af, {R6('value + f')} AS scen FROM {between_sql('model', 'af', 'f')}""")
def scaling_month(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    out = full(A.train("scaling", s.ref, s.hist, kind="+", group="time.month", by=BY), s.sim, interp="linear")
    return rounded(out.select("site", "time", "af", "scen"), "af", "scen")


@query("loci_month", f"""WITH p AS (SELECT site, month(time) AS grp, (1 + sum((value <= 60)::INT)) / (1 + count(*))::DOUBLE AS q FROM ref GROUP BY ALL),
    h AS (SELECT hist.site, month(time) AS grp, value, q FROM hist JOIN p ON p.site = hist.site AND p.grp = month(time)),
    o AS (SELECT *, row_number() OVER (PARTITION BY site, grp ORDER BY value) - 1 AS k, (count(*) OVER (PARTITION BY site, grp) - 1) * q AS pos FROM h),
    t AS (SELECT site, grp, min(value) + (any_value(pos) - floor(any_value(pos))) * (max(value) - min(value)) AS ht FROM o WHERE k = floor(pos) OR k = ceil(pos) GROUP BY ALL),
    w AS (SELECT h.site, h.grp, ht, avg(value) FILTER (value >= ht) AS mh FROM h JOIN t USING (site, grp) GROUP BY ALL),
    v AS (SELECT site, month(time) AS grp, avg(value) FILTER (value >= 60) AS mr FROM ref GROUP BY ALL),
    model AS (SELECT site, grp, ht, (mr - 60) / nullif(mh - ht, 0) AS af FROM w JOIN v USING (site, grp)),
    a AS {between_sql('model', 'af', 'f')}, b AS {between_sql('model', 'ht', 't', '(SELECT site, time, value, f FROM a)')}
    SELECT site, time, {R6('t')} AS hist_thresh, {R6('greatest(0, f * (value - t) + 60)')} AS scen FROM b""")
def loci_month(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    out = full(A.train("loci", s.ref, s.hist, thresh=60.0, group="time.month", by=BY), s.sim)
    return rounded(out.select("site", "time", "hist_thresh", "scen"), "hist_thresh", "scen")


def at_knots(i: int) -> str:
    return linear_sql("value", f"p{i}.hist_q", f"p{i}.af")


@query("eqm_month_linear", f"""WITH {TABLE.format(g='month(time)', n=N20, c='p[2] - p[1]')}, pads AS (SELECT * FROM model UNION ALL SELECT site, 0, hist_q, af FROM model WHERE grp = 12 UNION ALL SELECT site, 13, hist_q, af FROM model WHERE grp = 1),
    s AS (SELECT site, time, value, {INDEX} AS ix FROM sim), b AS (SELECT s.site, time, value, ix - floor(ix) AS part, {at_knots(0)} AS lo, {at_knots(1)} AS hi FROM s LEFT JOIN pads p0 ON p0.site = s.site AND p0.grp = floor(ix) LEFT JOIN pads p1 ON p1.site = s.site AND p1.grp = floor(ix) + 1)
    SELECT site, time, {R6('value + CASE WHEN part = 0 THEN lo ELSE lo + part * (hi - lo) END')} AS scen FROM b""")
def eqm_month_linear(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("eqm", s.ref, s.hist, nquantiles=20, kind="+", group="time.month", by=BY)
    return rounded(model.adjust(s.sim, interp="linear").select("site", "time", "scen"), "scen")


def widened_sql(source: str, half: int) -> str:
    """SQL of grouping.grouped() by day of the year with a window of 2 half + 1 steps."""
    k = f"(SELECT *, row_number() OVER (PARTITION BY site ORDER BY time) AS k FROM {source})"
    return f"(SELECT s.site, s.time, s.value, dayofyear(t.time) AS grp, s.k = t.k AS main FROM {k} t JOIN {k} s ON s.site = t.site AND s.k BETWEEN t.k - {half} AND t.k + {half})"


@query("eqm_doy_window", f"""WITH hq AS (SELECT site, grp, quantile_cont(value, {N10}) AS hist_q FROM {widened_sql('hist', 7)} GROUP BY ALL), rq AS (SELECT site, grp, quantile_cont(value, {N10}) AS ref_q FROM {widened_sql('ref', 7)} GROUP BY ALL),
    m AS (SELECT site, grp, hist_q, list_transform(list_zip(hist_q, ref_q), lambda p: p[2] - p[1]) AS af FROM hq JOIN rq USING (site, grp)) SELECT site, grp::INTEGER AS grp, {R6('hist_q[1]')} AS first_q, {R6('hist_q[10]')} AS last_q, {R6('af[5]')} AS middle_af FROM m""")
def eqm_doy_window(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    table = A.train("eqm", s.ref, s.hist, nquantiles=10, group=Grouper("time.dayofyear", 15), by=BY).table
    return rounded(table.select("site", "grp", F.get("hist_q", F.lit(0)).alias("first_q"), F.get("hist_q", F.lit(9)).alias("last_q"), F.get("af", F.lit(4)).alias("middle_af")), "first_q", "last_q", "middle_af")


@query("qdm_rank_window", f"""WITH w AS {widened_sql('sim', 2)}, q AS {rank_sql('w', 'value', 'site, grp', 'sim_q')} SELECT site, time, {R6('sim_q')} AS sim_q FROM q WHERE main""")
def qdm_rank_window(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("qdm", s.ref, s.hist, nquantiles=10, group=Grouper("time.dayofyear", 5), by=BY)
    return rounded(full(model, s.sim, rank_window=True).select("site", "time", "sim_q"), "sim_q")


@query("dqm_month_add", f"""WITH m AS (SELECT site, month(time) AS grp, quantile_cont(value, {N20}) AS h, avg(value) AS mh FROM hist GROUP BY ALL), n AS (SELECT site, month(time) AS grp, quantile_cont(value, {N20}) AS r, avg(value) AS mr FROM ref GROUP BY ALL),
    model AS (SELECT site, grp, list_transform(h, lambda q: q - mh) AS hist_q, list_transform(list_zip(h, r), lambda p: (p[2] - mr) - (p[1] - mh)) AS af, mr - mh AS scaling FROM m JOIN n USING (site, grp)),
    x AS (SELECT sim.site, time, month(time) AS g, value + scaling AS x, epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS t FROM sim LEFT JOIN model ON model.site = sim.site AND grp = month(time)),
    a AS (SELECT site, g, avg(t) AS mt, avg(x) AS mx FROM x GROUP BY ALL), b AS (SELECT x.site, x.g, mt, mx, sum((t - mt) * (x - mx)) / sum((t - mt) * (t - mt)) AS slope FROM x JOIN a ON a.site = x.site AND a.g = x.g GROUP BY ALL),
    d AS (SELECT x.*, mx + slope * (t - mt) AS trend FROM x JOIN b ON b.site = x.site AND b.g = x.g), e AS (SELECT site, time, g, trend, x - trend AS value FROM d),
    pads AS (SELECT site, grp, hist_q, af FROM model UNION ALL SELECT site, 0, hist_q, af FROM model WHERE grp = 12 UNION ALL SELECT site, 13, hist_q, af FROM model WHERE grp = 1), knots AS (SELECT site, grp, unnest(hist_q) AS xq, unnest(af) AS yq, generate_subscripts(hist_q, 1) AS i FROM pads),
    near AS (SELECT e.site, e.time, e.value, e.trend, e.g AS grp, arg_min(yq, {{'d': (e.value - xq) * (e.value - xq) + (e.g - knots.grp) * (e.g - knots.grp), 'g': knots.grp, 'i': i}}) AS inner_af FROM e JOIN knots ON e.site = knots.site GROUP BY ALL)
    SELECT site, time, {R6('trend')} AS trend, {R6('value + CASE WHEN value < hist_q[1] THEN af[1] WHEN value > hist_q[-1] THEN af[-1] ELSE inner_af END + trend')} AS scen FROM near LEFT JOIN model USING (site, grp)""")
def dqm_month(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("dqm", s.ref, s.hist, nquantiles=20, kind="+", group="time.month", by=BY)
    return rounded(full(model, s.sim).select("site", "time", "trend", "scen"), "trend", "scen")


@query("eqm_time_cubic")
def eqm_cubic(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("eqm", s.ref, s.hist, nquantiles=20, kind="+", by=BY)
    return rounded(model.adjust(s.sim, interp="cubic").select("site", "time", "scen"), "scen")


@query("outer_alignment", f"SELECT coalesce(ref.site, hist.site) AS site, coalesce(ref.time, hist.time) AS time, {R6('ref.value')} AS ref, {R6('hist.value')} AS hist FROM ref FULL JOIN hist ON ref.site = hist.site AND ref.time = hist.time")
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    both = s.ref.select("site", "time", F.col("value").alias("ref")).join(s.hist.select("site", "time", F.col("value").alias("hist")), ["site", "time"], "full")
    return rounded(both, "ref", "hist")


# before and after

@query("adapt_freq_time", f"""WITH r AS (SELECT site, avg((value <= 120)::INT) AS p0r FROM ref GROUP BY ALL), h AS (SELECT site, avg((value <= 120)::INT) AS p0h FROM hist GROUP BY ALL),
    p AS (SELECT site, p0r, p0h, (p0h - p0r) / nullif(p0h, 0) AS dp FROM r JOIN h USING (site)),
    o AS (SELECT ref.site, value, row_number() OVER (PARTITION BY ref.site ORDER BY value) - 1 AS k, (count(*) OVER (PARTITION BY ref.site) - 1) * p0h AS pos FROM ref JOIN p USING (site) WHERE dp > 0),
    q AS (SELECT site, min(value) + (any_value(pos) - floor(any_value(pos))) * (max(value) - min(value)) AS pth FROM o WHERE k = floor(pos) OR k = ceil(pos) GROUP BY ALL),
    a AS (SELECT site, time, value, row_number() OVER (PARTITION BY site ORDER BY value, {U('site', 'time')})::DOUBLE / count(*) OVER (PARTITION BY site) AS r0, avg((value <= 120)::INT) OVER (PARTITION BY site) AS p0s FROM hist),
    b AS (SELECT *, max(r0) OVER (PARTITION BY site) AS mx, min(r0) OVER (PARTITION BY site) AS mn FROM a),
    c AS (SELECT *, mx * ((r0 - mn) / nullif(mx - mn, 0)) AS rk FROM b)
    SELECT c.site, time, {R6(f"CASE WHEN dp > 0 AND rk >= p0r / p0h * p0s AND rk <= p0s THEN 120 + (pth - 120) * {U('c.site', 'time', seed=1)} ELSE value END")} AS value, {R6('dp')} AS dP0, {R6('pth')} AS pth FROM c LEFT JOIN p USING (site) LEFT JOIN q USING (site)""")
def adapt_freq(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    out, shares = P.adapt_freq(s.ref, s.hist, "time", 120.0, BY)
    return rounded(out.join(shares.select("site", "dP0", "pth"), "site").select("site", "time", "value", "dP0", "pth"), "value", "dP0", "pth")


@query("jitter_both", f"""SELECT site, time, {R6(f"CASE WHEN value >= 300 THEN 300 + 50 * {U('site', 'time', seed=1)} WHEN value < 40 THEN 40 * {U('site', 'time')} ELSE value END")} AS value FROM hist""")
def jitter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.jitter(Series(spark, sf).hist, lower=40.0, upper=300.0, maximum=350.0, keys=["site", "time"]).select("site", "time", "value"), "value")


@query("uniform_noise", f"SELECT site, time, round(1e-6 + (1e-3 - 1e-6) * {U('site', 'time', seed=7)}, 12) AS noise FROM hist")
def uniform_noise(spark: SparkSession, sf: str) -> DataFrame:
    return Series(spark, sf).hist.select("site", "time", F.round(P.noise(keys=["site", "time"], seed=7), 12).alias("noise"))


@query("normalize_month", f"SELECT site, time, {R6('value - avg(value) OVER (PARTITION BY site, month(time))')} AS value FROM hist")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.normalize(Series(spark, sf).hist, "time.month", "+", BY)[0].select("site", "time", "value"), "value")


@query("standardize", f"SELECT site, time, {R6('(value - avg(value) OVER (PARTITION BY site)) / nullif(stddev_pop(value) OVER (PARTITION BY site), 0)')} AS value FROM hist")
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.standardize(Series(spark, sf).hist, BY).select("site", "time", "value"), "value")


@query("unstandardize", f"SELECT site, time, {R6('value')} AS value FROM hist WHERE (SELECT count(DISTINCT value) FROM hist h WHERE h.site = hist.site) > 1")
def unstandardize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.unstandardize(P.standardize(Series(spark, sf).hist, BY)).select("site", "time", "value").where("value IS NOT NULL"), "value")


@query("reordering_month", f"""WITH r AS (SELECT site, time, month(time) AS g, row_number() OVER (PARTITION BY site, month(time) ORDER BY value, time) AS k FROM ref), h AS (SELECT site, value, month(time) AS g, row_number() OVER (PARTITION BY site, month(time) ORDER BY value, time) AS k FROM hist)
    SELECT r.site, r.time, {R6('h.value')} AS value FROM r JOIN h USING (site, g, k)""")
def reordering(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(P.reordering(s.ref, s.hist, "time.month", BY), "value")


@query("to_additive_log", f"SELECT site, time, {R6('ln(value - 0)')} AS value FROM hist WHERE value > 0")
def additive_log(spark: SparkSession, sf: str) -> DataFrame:
    return Series(spark, sf).hist.where("value > 0").select("site", "time", (F.round(C.to_additive(F.col("value"), 0.0), 6) + 0.0).alias("value"))


@query("to_additive_logit", f"SELECT site, time, {R6('ln((disc / 100) / (1 - disc / 100))')} AS value, {R6('disc')} AS back FROM hist WHERE disc > 0 AND disc < 100")
def additive_logit(spark: SparkSession, sf: str) -> DataFrame:
    y = C.to_additive(F.col("disc"), 0.0, 100.0, "logit", clip="permissive")
    return rounded(Series(spark, sf).hist.where("disc > 0 AND disc < 100").select("site", "time", y.alias("value"), C.from_additive(y, 0.0, 100.0, "logit").alias("back")), "value", "back")


@query("stack_variables", "SELECT site, time, 'disc' AS multivar, disc AS value FROM hist UNION ALL SELECT site, time, 'qty', qty FROM hist UNION ALL SELECT site, time, 'value', value FROM hist")
def stacked(spark: SparkSession, sf: str) -> DataFrame:
    return P.stack_variables(Series(spark, sf).hist, ["value", "qty", "disc"], ["site", "time"], value="out").withColumnRenamed("out", "value")


@query("unstack_variables", "SELECT site, time, disc, qty, value AS price FROM hist")
def unstacked(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.withColumnRenamed("value", "price")
    return P.unstack_variables(P.stack_variables(own, ["price", "qty", "disc"], ["site", "time"]), ["price", "qty", "disc"], ["site", "time"])


@query("escore_all", f"""WITH p AS (SELECT site, avg(value) AS m, stddev_pop(value) AS s, avg(qty) AS mq, stddev_pop(qty) AS sq FROM ref GROUP BY site),
    x AS (SELECT site, (value - m) / s AS u, (qty - mq) / sq AS v FROM ref JOIN p USING (site)), z AS (SELECT site, (value - m) / s AS u, (qty - mq) / sq AS v FROM hist JOIN p USING (site)),
    xy AS (SELECT x.site, avg(sqrt((x.u - z.u) ** 2 + (x.v - z.v) ** 2)) AS d FROM x JOIN z USING (site) GROUP BY ALL),
    xx AS (SELECT x.site, avg(sqrt((x.u - z.u) ** 2 + (x.v - z.v) ** 2)) AS d FROM x JOIN x z USING (site) GROUP BY ALL),
    zz AS (SELECT x.site, avg(sqrt((x.u - z.u) ** 2 + (x.v - z.v) ** 2)) AS d FROM z x JOIN z USING (site) GROUP BY ALL),
    n AS (SELECT site, count(*) AS n FROM x GROUP BY ALL), o AS (SELECT site, count(*) AS o FROM z GROUP BY ALL)
    SELECT xy.site, {R6('n * o / (n + o)::DOUBLE * (2 * xy.d - xx.d - zz.d) / 2')} AS escore FROM xy JOIN xx USING (site) JOIN zz USING (site) JOIN n USING (site) JOIN o USING (site)""")
def escore(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(P.escore(s.ref, s.hist, ["value", "qty"], BY, scale=True), "escore")


# order statistics

@query("rank_pct_month", f"WITH k AS (SELECT *, month(time) AS grp FROM hist), q AS {rank_sql('k', 'value', 'site, grp')} SELECT site, time, {R6('r')} AS r FROM q")
def rank_pct(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.withColumn("grp", F.month("time"))
    return rounded(S.percent_rank(own, "value", ["site", "grp"], "r").select("site", "time", "r"), "r")


@query("rank_tie_break", f"SELECT site, time, row_number() OVER (PARTITION BY site ORDER BY qty, {U('site', 'time', seed=3)})::DOUBLE AS r FROM hist")
def rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    own = S.percent_rank(Series(spark, sf).hist, "qty", BY, "p", tie_break=["site", "time"], seed=3)
    n = F.count("*").over(S.Window.partitionBy("site"))
    # (n rank - 1) / (n - 1) undone, to give whole numbers
    return own.select("site", "time", F.round(F.col("p") * (n - 1) + 1).alias("r"))


@query("ecdf", f"SELECT site, {R6('avg((value <= 150)::INT)')} AS ecdf FROM hist GROUP BY site")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.ecdf(Series(spark, sf).hist, F.lit(150.0), BY), "ecdf")


@query("map_cdf", f"""WITH q AS (SELECT site, (1 + sum((value <= 150)::INT)) / (1 + count(*))::DOUBLE AS q FROM ref GROUP BY ALL),
    o AS (SELECT hist.site, value, row_number() OVER (PARTITION BY hist.site ORDER BY value) - 1 AS k, (count(*) OVER (PARTITION BY hist.site) - 1) * q AS pos FROM hist JOIN q USING (site))
    SELECT site, {R6('min(value) + (any_value(pos) - floor(any_value(pos))) * (max(value) - min(value))')} AS mapped FROM o WHERE k = floor(pos) OR k = ceil(pos) GROUP BY site""")
def map_cdf(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(S.map_cdf(s.hist, s.ref, 150.0, BY), "mapped")


@query("quantiles_month", f"WITH m AS (SELECT site, month(time)::INTEGER AS grp, quantile_cont(value, {N20}) AS v FROM hist GROUP BY ALL), q AS (SELECT site, grp, unnest(v) AS v, unnest({N20})::DOUBLE AS q FROM m) SELECT site, grp, q, {R6('v')} AS value FROM q")
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = grouped(Series(spark, sf).hist, "time.month", BY).groupBy("site", "grp").agg(C.quantiles("value", C.nodes(20)).alias("v"))
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, C.nodes(20))).alias("q"), F.col("v")))
    return rounded(q.select("site", "grp", zipped.alias("p")).select("site", "grp", F.col("p.q").alias("q"), F.col("p.v").alias("value")), "value")


@query("quantile_of_each_group", f"""WITH o AS (SELECT site, month(time) AS grp, value, row_number() OVER (PARTITION BY site, month(time) ORDER BY value) - 1 AS k, (count(*) OVER (PARTITION BY site, month(time)) - 1) * (month(time) / 13.0::DOUBLE) AS pos FROM hist)
    SELECT site, grp, {R6('min(value) + (any_value(pos) - floor(any_value(pos))) * (max(value) - min(value))')} AS quantile FROM o WHERE k = floor(pos) OR k = ceil(pos) GROUP BY ALL""")
def vector_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.withColumn("grp", F.month("time")).withColumn("q", F.month("time") / 13.0)
    return rounded(S.at_quantile(own, "q", ["site", "grp"]), "quantile")


RUN = "sum(CASE WHEN {c} AND NOT coalesce(lag({c}) OVER ({w}), false) THEN 1 ELSE 0 END) OVER ({w})"


@query("clusters", """WITH a AS (SELECT site, time, value, value > 150 AS c FROM hist), b AS (SELECT *, CASE WHEN c AND NOT coalesce(lag(c) OVER (PARTITION BY site ORDER BY time), false) THEN 1 ELSE 0 END AS st FROM a), d AS (SELECT *, sum(st) OVER (PARTITION BY site ORDER BY time) AS run FROM b),
    e AS (SELECT site, run, min(time) AS "start", max(time) AS "end", arg_min(time, {'v': -value, 't': time}) AS maxpos, max(value) AS maximum FROM d WHERE c GROUP BY site, run HAVING max(value) > 250)
    SELECT site, row_number() OVER (PARTITION BY site ORDER BY "start")::INTEGER AS cluster, "start", "end", maxpos, round(maximum, 6) AS maximum FROM e""")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.clusters(Series(spark, sf).hist, 250.0, 150.0, BY), "maximum")


@query("random_tie_break", f"""WITH g AS (SELECT site, time, qty, qty - lag(qty) OVER (PARTITION BY site ORDER BY qty) AS gap FROM hist), m AS (SELECT *, min(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY site) AS least FROM g)
    SELECT site, time, {R6(f"qty + coalesce(least, 0) * (0.1::DOUBLE + 0.15::DOUBLE * {U('site', 'time', seed=2)})")} AS broken FROM m""")
def random_tie_break(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.tie_break(Series(spark, sf).hist, BY, "qty", seed=2).select("site", "time", "broken"), "broken")


@query("bin_width", f"SELECT site, {R6('2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * power(count(value), -1 / 3.0::DOUBLE)')} AS value, {R6('2 * (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) * power(count(qty), -1 / 3.0::DOUBLE)')} AS qty FROM hist GROUP BY site")
def bin_width(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.bin_widths(Series(spark, sf).hist, ["value", "qty"], BY), "value", "qty")


@query("histogram_nd", f"SELECT site, floor(value / 25)::BIGINT AS bin_value, floor(qty / 40)::BIGINT AS bin_qty, (floor(value / 25) + 0.5::DOUBLE) * 25 AS centre_value, (floor(qty / 40) + 0.5::DOUBLE) * 40 AS centre_qty, {R6('count(*) / sum(count(*)) OVER (PARTITION BY site)::DOUBLE')} AS frequency FROM hist GROUP BY site, floor(value / 25), floor(qty / 40)")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.histogram(Series(spark, sf).hist, {"value": 25.0, "qty": 40.0}, 0.0, BY), "frequency")


# groups of times

@query("group_index", f"SELECT DISTINCT time, month(time)::INTEGER AS month, ((month(time) % 12) // 3)::INTEGER AS season, dayofyear(time)::INTEGER AS doy, week(time)::INTEGER AS week, {R6(INDEX)} AS month_index, {R6('dayofyear(time)::DOUBLE / dayofyear(make_date(year(time), 12, 31)) * 4 - 1 / 6.0::DOUBLE')} AS season_index FROM hist")
def group_index(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("time")
    own = [C.group_key(t, f"time.{g}").alias(n) for g, n in (("month", "month"), ("season", "season"), ("dayofyear", "doy"), ("week", "week"))]
    return rounded(Series(spark, sf).hist.select("time", *own, C.group_index(t, "time.month").alias("month_index"), C.group_index(t, "time.season").alias("season_index")).distinct(), "month_index", "season_index")


@query("window_groups", f"""WITH a AS (SELECT site, time, value, row_number() OVER (PARTITION BY site ORDER BY time) AS k FROM hist), b AS (SELECT t.site, dayofyear(t.time) AS grp, s.value FROM a t JOIN a s ON s.site = t.site AND s.k BETWEEN t.k - 2 AND t.k + 2)
    SELECT site, grp::INTEGER AS grp, count(*) AS n, {R6('avg(value)')} AS mean, {R6('quantile_cont(value, 0.5)')} AS median FROM b GROUP BY site, grp""")
def window_groups(spark: SparkSession, sf: str) -> DataFrame:
    own = grouped(Series(spark, sf).hist, Grouper("time.dayofyear", 5), BY)
    return rounded(own.groupBy("site", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median")), "mean", "median")


@query("cyclic_bounds", f"WITH m AS (SELECT site, month(time)::INTEGER AS grp, avg(value) AS m FROM hist GROUP BY ALL), p AS (SELECT * FROM m UNION ALL SELECT site, 0, m FROM m WHERE grp = 12 UNION ALL SELECT site, 13, m FROM m WHERE grp = 1) SELECT site, grp, {R6('m')} AS mean FROM p")
def cyclic_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cyclic(R.mean(Series(spark, sf).hist, "time.month", BY), "time.month"), "mean")


@query("broadcast_season", f"WITH m AS (SELECT site, (month(time) % 12) // 3 AS grp, avg(value) AS m FROM hist GROUP BY ALL) SELECT sim.site, time, {R6('m')} AS factor FROM sim LEFT JOIN m ON m.site = sim.site AND m.grp = (month(time) % 12) // 3")
def broadcast_season(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    out = broadcast_groups(s.sim, R.mean(s.hist, "time.season", BY), "time.season", "mean", BY)
    return rounded(out.select("site", "time", "factor"), "factor")


@query("time_blocks_5d", "SELECT site, ((least(dayofyear(time), 365) - 1) // 5 + o + 73) % 73 + 1 AS block, count(*) AS n, sum((o = 0)::INT)::BIGINT AS n_main FROM hist, (SELECT unnest([-1, 0, 1]) AS o) GROUP BY ALL")
def blocks_5d(spark: SparkSession, sf: str) -> DataFrame:
    own = time_blocks(Series(spark, sf).hist, "5D", 3, BY)
    return own.groupBy("site", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.sum(F.col("main").cast("long")).alias("n_main"))


@query("stack_periods", """WITH p AS (SELECT unnest([1995, 1996, 1997, 1998]) AS y0)
    SELECT site, time, make_date(y0, 1, 1) AS period, row_number() OVER (PARTITION BY site, y0 ORDER BY time)::INTEGER AS step FROM p JOIN (SELECT site, time FROM daily WHERE st = 'F') d ON year(time) BETWEEN y0 AND y0 + 2""")
def stack_periods(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).daily.where("st = 'F'").select("site", "time", "value")
    return T.stack_periods(own, 3, 1, by=BY).select("site", "time", "period", "step")


@query("unstack_periods", f"SELECT site, time, {R6('value')} AS value FROM daily WHERE st = 'F' AND year(time) BETWEEN 1995 AND 2000")
def unstack_periods(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).daily.where("st = 'F'").select("site", "time", "value")
    return rounded(T.unstack_periods(T.stack_periods(own, 3, 1, by=BY), 3, 1, BY), "value")


@query("rescale_days", f"""WITH m AS (SELECT site, dayofyear(time) AS doy, avg(value) AS v FROM hist GROUP BY ALL), x AS (SELECT *, 1 + (doy - 1) * (359 / 365.0::DOUBLE) AS x, row_number() OVER (PARTITION BY site ORDER BY doy) AS k FROM m),
    y AS (SELECT *, lead(x) OVER w AS x1, lead(v) OVER w AS v1 FROM x WINDOW w AS (PARTITION BY site ORDER BY doy)), d AS (SELECT unnest(range(1, 361))::INTEGER AS d),
    z AS (SELECT site, d, v, x, x1, v1 FROM y JOIN d ON d >= CASE WHEN k = 1 THEN 1 ELSE ceil(x - 1e-9) END AND d <= CASE WHEN x1 IS NULL THEN 360 ELSE ceil(x1 - 1e-9) - 1 END)
    SELECT site, d AS doy, {R6('CASE WHEN d < x OR x1 IS NULL THEN v ELSE v + (d - x) / (x1 - x) * (v1 - v) END')} AS value FROM z""")
def rescale_days(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.groupBy("site", F.dayofyear("time").alias("doy")).agg(F.avg("value").alias("value"))
    return rounded(T.rescale_days(own, 360, BY), "value")


# trends

@query("mean_detrend", f"SELECT site, time, {R6('value - avg(value) OVER (PARTITION BY site, (month(time) % 12) // 3)')} AS value FROM hist")
def mean_detrend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.detrended(D.mean(Series(spark, sf).hist, "time.season", BY)).select("site", "time", "value"), "value")


@query("poly_detrend1", f"""WITH s AS (SELECT site, time, value, epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS t FROM hist), a AS (SELECT site, avg(t) AS mt, avg(value) AS mx FROM s GROUP BY ALL),
    b AS (SELECT site, mt, mx, sum((t - mt) * (value - mx)) / sum((t - mt) * (t - mt)) AS slope FROM s JOIN a USING (site) GROUP BY ALL)
    SELECT site, time, {R6('mx + slope * (t - mt)')} AS trend, {R6('value - (mx + slope * (t - mt))')} AS value FROM s JOIN b USING (site)""")
def poly1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.detrended(D.polynomial(Series(spark, sf).hist, degree=1, by=BY)).select("site", "time", "trend", "value"), "trend", "value")


def orthogonal_sql(degree: int) -> str:
    """Tables o0, o1, ... of hist with `trend` and the polynomial p orthogonal to those of lower degrees over the times of each site."""
    out = ["""o0 AS (SELECT site, time, value, 2 * (t - t0) / (t1 - t0) - 1 AS x, 1.0::DOUBLE AS p, 0.0::DOUBLE AS b, 1.0::DOUBLE AS nb, m AS trend
        FROM (SELECT site, time, value, epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS t FROM hist) JOIN (SELECT site, min(epoch(time::TIMESTAMP)) / 86400.0::DOUBLE AS t0, max(epoch(time::TIMESTAMP)) / 86400.0::DOUBLE AS t1, avg(value) AS m FROM hist GROUP BY site) USING (site))"""]
    for k in range(degree):
        out += [
            f"a{k} AS (SELECT site, sum(p * p) AS n, sum(x * p * p) / sum(p * p) AS a FROM o{k} GROUP BY site)",
            f"q{k} AS (SELECT o{k}.*, (x - a) * p - n / nb * b AS q, n FROM o{k} JOIN a{k} USING (site))",
            f"c{k} AS (SELECT site, sum(value * q) / sum(q * q) AS c FROM q{k} GROUP BY site)",
            f"o{k + 1} AS (SELECT site, time, value, x, q AS p, p AS b, n AS nb, trend + c * q AS trend FROM q{k} JOIN c{k} USING (site))",
        ]
    return ", ".join(out)


@query("poly_detrend4", f"WITH {orthogonal_sql(4)} SELECT site, time, {R6('trend')} AS trend, {R6('value - trend')} AS value FROM o4")
def poly4(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.select("site", "time", "value")
    return rounded(D.detrended(D.polynomial(own, degree=4, by=BY)), "trend", "value")


@query("rolling_detrend", f"""WITH a AS (SELECT site, time, value, count(value) OVER w AS n, avg(value) OVER w AS m FROM hist WINDOW w AS (PARTITION BY site ORDER BY time ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
    SELECT site, time, {R6('CASE WHEN n >= 20 THEN value - m END')} AS value FROM a""")
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.detrended(D.rolling_mean(Series(spark, sf).hist, 30, min_periods=20, by=BY)).select("site", "time", "value"), "value")


@query("loess_detrend", f"""WITH s AS (SELECT site, value AS y, time, epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS t, row_number() OVER (PARTITION BY site ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY site) AS n, lead(epoch(time::TIMESTAMP)) OVER (PARTITION BY site ORDER BY time) / 86400.0::DOUBLE - epoch(time::TIMESTAMP) / 86400.0::DOUBLE AS gap FROM hist),
    g AS (SELECT site, min(gap) = max(gap) AS even, min(gap) AS dx, (2 * floor(0.1::DOUBLE * any_value(n) / 2) + 1)::BIGINT AS r, least(round_even(0.1::DOUBLE * any_value(n), 0), any_value(n) - 1)::BIGINT AS k FROM s GROUP BY site),
    p AS (SELECT a.site, a.i, b.i AS j, abs(b.t - a.t) AS d, row_number() OVER (PARTITION BY a.site, a.i ORDER BY abs(b.t - a.t)) - 1 AS o FROM s a JOIN s b USING (site)),
    h AS (SELECT s.site, i, CASE WHEN even THEN dx * CASE WHEN i < (r - 1) // 2 THEN r - i WHEN i >= n - (r - 1) // 2 THEN i - (n - r) + 1 ELSE (r - 1) // 2 + 1 END ELSE d END AS reach FROM s JOIN g USING (site) JOIN p USING (site, i) WHERE o = k),
    w AS (SELECT a.site, a.i, power(1 - power(abs(b.t - a.t) / reach, 3), 3) AS w, b.t - a.t AS x, b.y FROM s a JOIN h USING (site, i) JOIN s b ON b.site = a.site AND abs(b.t - a.t) < reach),
    z AS (SELECT site, i, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS y0, sum(w * x * y) AS y1 FROM w GROUP BY ALL),
    f AS (SELECT site, i, y0 / s0 - CASE WHEN s2 - s1 * s1 / s0 > 0 THEN (y1 - s1 * y0 / s0) / (s2 - s1 * s1 / s0) * (s1 / s0) ELSE 0 END AS trend FROM z)
    SELECT site, time, {R6('trend')} AS trend, {R6('y - trend')} AS value FROM s JOIN f USING (site, i)""")
def loess_detrend(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.select("site", "time", "value")
    return rounded(D.detrended(D.local_regression(own, BY, f=0.1, d=1)), "trend", "value")


# properties

for _name, _sql in {"mean": "avg(value)", "var": "var_pop(value)", "std": "stddev_pop(value)", "quantile": "quantile_cont(value, 0.98)", "skewness": "(avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / power(var_pop(value), 1.5)"}.items():

    @query(f"prop_{_name}", f"SELECT site, month(time)::INTEGER AS grp, {R6(_sql)} AS {_name} FROM hist GROUP BY ALL")
    def moment(spark: SparkSession, sf: str, name: str = _name) -> DataFrame:
        return rounded(getattr(R, name)(Series(spark, sf).hist, group="time.month", by=BY), name)


def spells_sql(cond: str, window: int, per: str, over: str, value: str = "value") -> str:
    return f"""WITH a AS (SELECT site, time, date_trunc('month', time) AS p, {cond} AS c FROM hist), b AS (SELECT *, CASE WHEN c AND NOT coalesce(lag(c) OVER (PARTITION BY site, p ORDER BY time), false) THEN 1 ELSE 0 END AS st FROM a),
    d AS (SELECT *, sum(st) OVER (PARTITION BY site, p ORDER BY time) AS run FROM b), e AS (SELECT site, p, run, count(*) AS n FROM d WHERE c GROUP BY ALL HAVING count(*) >= {window}), f AS (SELECT site, p, {per}(n)::DOUBLE AS s FROM e GROUP BY ALL),
    g AS (SELECT DISTINCT site, p FROM a) SELECT site, month(p)::INTEGER AS grp, {R6(f'{over}(coalesce(s, 0))')} AS spell FROM g LEFT JOIN f USING (site, p) GROUP BY ALL"""


@query("spell_length_month", spells_sql("value >= 120", 2, "max", "avg"))
def spells(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.spell_length_distribution(Series(spark, sf).hist, thresh=120.0, window=2, stat="mean", stat_resample="max", group="time.month", by=BY), "spell")


@query("threshold_count_month", spells_sql("value < 100", 1, "sum", "avg"))
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.threshold_count(Series(spark, sf).hist, op="<", thresh=100.0, group="time.month", by=BY), "spell")


@query("bivariate_spell_month", spells_sql("value >= 120 AND qty >= 80", 1, "avg", "max"))
def bivariate_spells(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.bivariate_spell_length_distribution(Series(spark, sf).hist, ("value", "qty"), threshs=(120.0, 80.0), stat="max", stat_resample="mean", group="time.month", by=BY), "spell")


@query("bivariate_threshold_count", spells_sql("value >= 120 AND qty < 120", 1, "sum", "max"))
def bivariate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.bivariate_threshold_count(Series(spark, sf).hist, ("value", "qty"), ops=(">=", "<"), threshs=(120.0, 120.0), stat="max", group="time.month", by=BY), "spell")


@query("acf_month", f"""WITH a AS (SELECT site, time, date_trunc('month', time) AS p, value - avg(value) OVER (PARTITION BY site, date_trunc('month', time)) AS d FROM hist), b AS (SELECT *, lead(d, 2) OVER (PARTITION BY site, p ORDER BY time) AS l FROM a),
    e AS (SELECT site, p, coalesce(sum(d * l), 0) / nullif(sum(d * d), 0) AS r FROM b GROUP BY ALL) SELECT site, month(p)::INTEGER AS grp, {R6('avg(r)')} AS acf FROM e GROUP BY ALL""")
def acf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.acf(Series(spark, sf).hist, 2, "time.month", BY), "acf")


CYCLE = """WITH m AS (SELECT site, dayofyear(time) AS doy, avg(value) AS m FROM hist GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY doy) AS k, count(*) OVER (PARTITION BY site) AS n FROM m),
    w AS (SELECT *, true AS main FROM k UNION ALL SELECT site, doy, m, k - n, n, false FROM k WHERE k > n - 15 UNION ALL SELECT site, doy, m, k + n, n, false FROM k WHERE k <= 15),
    r AS (SELECT *, CASE WHEN count(m) OVER v = 31 THEN avg(m) OVER v END AS c FROM w WINDOW v AS (PARTITION BY site ORDER BY k ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)), c AS (SELECT site, doy, c FROM r WHERE main)"""
_HIGH, _LOW = "arg_min(doy, {'c': -c, 'd': doy}) FILTER (c IS NOT NULL)", "arg_min(doy, {'c': c, 'd': doy}) FILTER (c IS NOT NULL)"
for _name, _stat, _sql in (("amplitude", "absamp", R6("max(c) - min(c)")), ("relative_amplitude", "relamp", R6("(max(c) - min(c)) * 100 / avg(c)")), ("phase", "phase", f"({_HIGH})::INTEGER"), ("asymmetry", "asymmetry", R6(f"(((({_HIGH}) - ({_LOW})) % 365 + 365) % 365) / 365.0::DOUBLE")), ("minimum", "min", R6("min(c)")), ("maximum", "max", R6("max(c)"))):

    @query(f"annual_cycle_{_name}", f'{CYCLE} SELECT site, {_sql} AS "{_stat}" FROM c GROUP BY site')
    def cycle(spark: SparkSession, sf: str, stat: str = _stat) -> DataFrame:
        out = R.annual_cycle_stat(Series(spark, sf).hist, stat, 31, BY)
        return out if stat == "phase" else rounded(out, stat)


for _name, _stat, _sql in (("range", "absamp", "max(s) - min(s)"), ("relative_range", "relamp", "(max(s) - min(s)) * 100 / avg(s)"), ("phase", "phase", "dayofyear(arg_min(time, {'v': -s, 't': time}) FILTER (s IS NOT NULL))")):

    @query(f"mean_annual_{_name}", f"""WITH a AS (SELECT site, time, CASE WHEN count(value) OVER w = 31 THEN avg(value) OVER w END AS s FROM hist WINDOW w AS (PARTITION BY site ORDER BY time ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
        y AS (SELECT site, year(time) AS y, {_sql} AS v FROM a GROUP BY ALL) SELECT site, {R6('avg(v)')} AS "{_stat}" FROM y GROUP BY site""")
    def annual(spark: SparkSession, sf: str, stat: str = _stat) -> DataFrame:
        return rounded(R.annual_statistic(Series(spark, sf).hist, stat, 31, BY), stat)


@query("corr_pearson_month", f"SELECT site, month(time)::INTEGER AS grp, {R6('corr(value, qty)')} AS correlation FROM hist GROUP BY ALL")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.corr_btw_var(Series(spark, sf).hist, ("value", "qty"), "pearson", "time.month", by=BY), "correlation")


def average_sql(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE"


@query("corr_spearman", f"WITH r AS (SELECT site, {average_sql('value', 'site')} AS a, {average_sql('disc', 'site')} AS b FROM hist) SELECT site, 1 AS grp, {R6('corr(a, b)')} AS correlation FROM r GROUP BY site")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.corr_btw_var(Series(spark, sf).hist, ("value", "disc"), by=BY), "correlation")


def pvalue_sql(source: str, keys: str) -> str:
    """SQL of the two-sided p-value of correlations r over n pairs: one less the finite series of Student's distribution in the angle whose sine is r."""
    even = "(n - 2) % 2 = 0"
    return f"""(WITH a AS (SELECT {keys}, abs(r) AS r, n FROM {source}),
        j AS (SELECT {keys}, r, n, unnest(range(0, CASE WHEN {even} THEN (n - 2) // 2 ELSE (n - 3) // 2 END)) AS j FROM a),
        l AS (SELECT {keys}, CASE WHEN {even} THEN 0 ELSE 0.5::DOUBLE * ln(1 - r * r) END + sum(CASE WHEN j = 0 THEN 0 ELSE ln(1 - r * r) + CASE WHEN {even} THEN ln((2 * j - 1) / (2 * j)::DOUBLE) ELSE ln(2 * j / (2 * j + 1)::DOUBLE) END END) OVER (PARTITION BY {keys} ORDER BY j) AS l FROM j WHERE r < 1),
        t AS (SELECT {keys}, sum(exp(l)) AS s FROM l GROUP BY {keys})
        SELECT {keys}, CASE WHEN n <= 2 THEN NULL WHEN r >= 1 THEN 0 WHEN {even} THEN 1 - r * coalesce(s, 0) ELSE 1 - 2 / pi() * (asin(r) + r * coalesce(s, 0)) END AS pvalue FROM a LEFT JOIN t USING ({keys}))"""


@query("corr_pvalue", f"WITH k AS (SELECT site, {average_sql('value', 'site')} AS a, {average_sql('disc', 'site')} AS b FROM hist), c AS (SELECT site, corr(a, b) AS r, count(*) AS n FROM k GROUP BY site) SELECT site, 1 AS grp, {R6('pvalue')} AS pvalue FROM {pvalue_sql('c', 'site')}")
def corr_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.corr_btw_var(Series(spark, sf).hist, ("value", "disc"), output="pvalue", by=BY), "pvalue")


@query("relative_frequency", f"SELECT site, month(time)::INTEGER AS grp, {R6('sum((value >= 150)::INT) / count(*)::DOUBLE')} AS frequency FROM hist GROUP BY ALL")
def frequency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.relative_frequency(Series(spark, sf).hist, ">=", 150.0, "time.month", BY), "frequency")


@query("transition_probability", f"""WITH a AS (SELECT site, time, value, lead(value) OVER (PARTITION BY site ORDER BY time) AS n FROM hist) SELECT site, month(time)::INTEGER AS grp, {R6('avg((value >= 120 AND n < 120)::INT)')} AS probability FROM a WHERE n IS NOT NULL GROUP BY ALL""")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.transition_probability(Series(spark, sf).hist, ">=", "<", 120.0, "time.month", BY), "probability")


for _output, _sql in {"slope": "regr_slope(m, k)", "intercept": "regr_intercept(m, k)", "rvalue": "corr(m, k)", "stderr": "sqrt((1 - corr(m, k) ** 2) * var_pop(m) / nullif(var_pop(k) * (count(*) - 2), 0))"}.items():

    @query(f"trend_{_output}", f"""WITH p AS (SELECT site, date_trunc('month', time) AS p, avg(value) AS m FROM hist GROUP BY ALL), k AS (SELECT site, month(p) AS grp, m, (row_number() OVER (PARTITION BY site, month(p) ORDER BY p) - 1)::DOUBLE AS k FROM p)
        SELECT site, grp::INTEGER AS grp, {R6(_sql)} AS {_output} FROM k GROUP BY site, grp""")
    def trend(spark: SparkSession, sf: str, output: str = _output) -> DataFrame:
        return rounded(R.trend(Series(spark, sf).hist, "time.month", output, BY), output)


@query("trend_pvalue", f"""WITH p AS (SELECT site, date_trunc('year', time) AS p, avg(value) AS m FROM hist GROUP BY ALL), k AS (SELECT site, m, (row_number() OVER (PARTITION BY site ORDER BY p) - 1)::DOUBLE AS k FROM p),
    c AS (SELECT site, corr(m, k) AS r, count(*) AS n FROM k GROUP BY site) SELECT site, 1 AS grp, {R6('pvalue')} AS pvalue FROM {pvalue_sql('c', 'site')}""")
def trend_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.trend(Series(spark, sf).hist, "time", "pvalue", BY), "pvalue")


@query("return_value", f"""WITH e AS (SELECT site, month(time) AS grp, max(value) AS x FROM daily WHERE st = 'F' GROUP BY site, month(time), year(time)),
    o AS (SELECT *, (row_number() OVER (PARTITION BY site, grp ORDER BY x) - 1)::DOUBLE AS i, count(*) OVER (PARTITION BY site, grp)::DOUBLE AS n FROM e),
    b AS (SELECT site, grp, n, avg(x) AS b0, sum(i * x) / (n * (n - 1)) AS b1, sum(i * (i - 1) * x) / (n * (n - 1) * (n - 2)) AS b2 FROM o WHERE n > 2 GROUP BY site, grp, n),
    l AS (SELECT site, grp, b0, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM b), z AS (SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS z FROM l), c AS (SELECT *, 7.859::DOUBLE * z + 2.9554::DOUBLE * z * z AS c FROM z),
    d AS (SELECT *, gamma(1 + c) AS g, l2 * c / (gamma(1 + c) * (1 - power(2, -c))) AS scale FROM c)
    SELECT site, grp::INTEGER AS grp, round(b0 - scale * (1 - g) / c + scale * (1 - power(-ln(0.9::DOUBLE), c)) / c + 3.7e-10, 4) + 0.0 AS return_value FROM d""")
def return_value(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.return_value(Series(spark, sf).daily.where("st = 'F'"), 10, "max", "PWM", "time.month", BY), "return_value", digits=4)


# measures

for _name, _sql in {"bias": "s - r", "relative_bias": "(s - r) / nullif(r, 0)", "ratio": "s / nullif(r, 0)"}.items():

    @query(f"measure_{_name}", f"WITH x AS (SELECT site, month(time) AS grp, stddev_pop(value) AS s FROM hist GROUP BY ALL), y AS (SELECT site, month(time) AS grp, stddev_pop(value) AS r FROM ref GROUP BY ALL) SELECT site, grp::INTEGER AS grp, {R6(_sql)} AS {_name} FROM x JOIN y USING (site, grp)")
    def measured(spark: SparkSession, sf: str, name: str = _name) -> DataFrame:
        s = Series(spark, sf)
        return rounded(M.compare(name, R.std(s.hist, "time.month", BY), R.std(s.ref, "time.month", BY), ["site", "grp"], "std"), name)


@query("measure_circular_bias", f"""WITH x AS (SELECT site, date_trunc('month', time) AS p, dayofyear(arg_max(time, {{'v': value, 't': time}})) AS s FROM hist GROUP BY ALL), y AS (SELECT site, date_trunc('month', time) + INTERVAL 11 MONTH AS p, dayofyear(arg_max(time, {{'v': value, 't': time}})) AS r FROM ref GROUP BY ALL),
    d AS (SELECT site, p, s, r, ((s - r) % 365 + 365) % 365 AS d FROM x JOIN y USING (site, p)), e AS (SELECT *, CASE WHEN d > 182.5 THEN 365 - d ELSE d END AS e FROM d)
    SELECT site, CAST(p AS DATE) AS p, (CASE WHEN r >= s THEN e ELSE -e END)::INTEGER AS circular_bias FROM e""")
def circular(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    top = lambda df: df.groupBy("site", F.trunc("time", "month").alias("p")).agg(F.dayofyear(F.max(F.struct("value", "time"))["time"]).alias("doy"))
    return M.compare("circular_bias", top(s.hist), top(s.ref).withColumn("p", F.add_months("p", 11)), ["site", "p"], "doy")


@query("measure_rmse", f"SELECT hist.site, month(hist.time)::INTEGER AS grp, {R6('sqrt(avg((hist.value - ref.value) ** 2))')} AS rmse FROM hist JOIN ref USING (site, time) GROUP BY ALL")
def rmse(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(M.rmse(s.hist, s.ref, "time.month", BY), "rmse")


@query("measure_mae", f"SELECT hist.site, month(hist.time)::INTEGER AS grp, {R6('avg(abs(hist.value - ref.value))')} AS mae FROM hist JOIN ref USING (site, time) GROUP BY ALL")
def mae(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(M.mae(s.hist, s.ref, "time.month", BY), "mae")


@query("annual_cycle_correlation", f"""WITH h AS (SELECT site, time, value, row_number() OVER (PARTITION BY site ORDER BY time) AS k FROM hist), r AS (SELECT site, time, value, row_number() OVER (PARTITION BY site ORDER BY time) AS k FROM ref),
    x AS (SELECT t.site, dayofyear(t.time) AS g, avg(s.value) AS s FROM h t JOIN h s ON s.site = t.site AND s.k BETWEEN t.k - 7 AND t.k + 7 GROUP BY ALL), y AS (SELECT t.site, dayofyear(t.time) AS g, avg(s.value) AS r FROM r t JOIN r s ON s.site = t.site AND s.k BETWEEN t.k - 7 AND t.k + 7 GROUP BY ALL)
    SELECT site, {R6('corr(s, r)')} AS correlation FROM x JOIN y USING (site, g) GROUP BY site""")
def cycle_correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(M.annual_cycle_correlation(s.hist, s.ref, 15, BY), "correlation")


@query("taylor_diagram", f"""WITH a AS (SELECT hist.site, stddev_pop(ref.value) AS ref_std, stddev_pop(hist.value) AS sim_std, corr(hist.value, ref.value) AS corr FROM hist JOIN ref USING (site, time) GROUP BY ALL)
    SELECT site, 'ref_std' AS taylor_param, {R6('ref_std')} AS out FROM a UNION ALL SELECT site, 'sim_std', {R6('sim_std')} FROM a UNION ALL SELECT site, 'corr', {R6('corr')} FROM a""")
def taylor(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    return rounded(M.taylor_diagram(s.hist, s.ref, BY), "out")


# sites in space

NATIONS = """WITH n AS (SELECT s_nationkey AS site, CAST(l_shipdate AS DATE) AS time, l_linestatus AS st, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100000 AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    c AS (SELECT n_nationkey AS site, n_nationkey * 1.5::DOUBLE AS lon, 45 + (n_nationkey % 3) * 0.5::DOUBLE AS lat FROM nation)"""


def spearman_sql(st: str, name: str) -> str:
    return f"""{name}_d AS (SELECT site, time, value - avg(value) OVER (PARTITION BY time) AS d FROM n WHERE st = '{st}'), {name}_p AS (SELECT x.site AS a, y.site AS b, x.d AS x, y.d AS y FROM {name}_d x JOIN {name}_d y USING (time)),
    {name}_r AS (SELECT a, b, {average_sql('x', 'a, b')} AS rx, {average_sql('y', 'a, b')} AS ry FROM {name}_p), {name} AS (SELECT a, b, corr(rx, ry) AS corr FROM {name}_r GROUP BY ALL)"""


KM = "6367.0::DOUBLE * atan2(sqrt((cos(radians(y.lat)) * sin(radians(y.lon - x.lon))) ** 2 + (cos(radians(x.lat)) * sin(radians(y.lat)) - sin(radians(x.lat)) * cos(radians(y.lat)) * cos(radians(y.lon - x.lon))) ** 2), sin(radians(x.lat)) * sin(radians(y.lat)) + cos(radians(x.lat)) * cos(radians(y.lat)) * cos(radians(y.lon - x.lon)))"


def nations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    own = lines.join(spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    series = own.groupBy(F.col("s_nationkey").alias("site"), F.col("l_shipdate").cast("date").alias("time"), F.col("l_linestatus").alias("st")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100000).alias("value"))
    sites = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("site"), (F.col("n_nationkey") * 1.5).alias("lon"), (45 + F.col("n_nationkey") % 3 * 0.5).alias("lat"))
    return series, sites


@query("pairwise_spearman", f"{NATIONS}, {spearman_sql('O', 'o')} SELECT a, b, {R6('corr')} AS corr FROM o")
def pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.pairwise_spearman(nations(spark, sf)[0].where("st = 'O'")), "corr")


@query("scorr", f"{NATIONS}, {spearman_sql('O', 'o')}, {spearman_sql('F', 'f')} SELECT {R6('sum(f.corr - o.corr)')} AS scorr FROM f JOIN o USING (a, b)")
def scorr(spark: SparkSession, sf: str) -> DataFrame:
    own = nations(spark, sf)[0]
    return rounded(M.scorr(own.where("st = 'F'"), own.where("st = 'O'")), "scorr")


@query("haversine_pairs", f"{NATIONS} SELECT x.site AS a, y.site AS b, {R6(f'CASE WHEN x.site = y.site THEN 0 ELSE {KM} END')} AS km FROM c x, c y")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.distances(nations(spark, sf)[1]), "km")


@query("spatial_correlogram", f"""{NATIONS}, {spearman_sql('O', 'o')}, k AS (SELECT x.site AS a, y.site AS b, {KM} AS km FROM c x, c y WHERE x.site < y.site), e AS (SELECT min(km) * 0.9999::DOUBLE AS lo, max(km) * 1.0001::DOUBLE AS hi FROM k),
    w AS (SELECT corr, lo, (hi - lo) / 5 AS w, least(floor((km - lo) / ((hi - lo) / 5)), 4) AS bin FROM k JOIN o USING (a, b), e WHERE corr IS NOT NULL) SELECT {R6('any_value(lo) + (bin + 0.5::DOUBLE) * any_value(w)')} AS distance, {R6('avg(corr)')} AS corr FROM w GROUP BY bin""")
def correlogram(spark: SparkSession, sf: str) -> DataFrame:
    own, sites = nations(spark, sf)
    return rounded(R.spatial_correlogram(own.where("st = 'O'"), sites, 5), "distance", "corr")


@query("decorrelation_length", f"""{NATIONS}, {spearman_sql('O', 'o')}, k AS (SELECT x.site AS a, y.site AS b, CASE WHEN x.site = y.site THEN 0 ELSE {KM} END AS km FROM c x, c y), m AS (SELECT a, floor(km / 50) AS bin, avg(corr) AS c FROM k JOIN o USING (a, b) WHERE km < 500 AND corr IS NOT NULL GROUP BY ALL)
    SELECT a AS site, {R6("(arg_min(bin, {'d': abs(c - 0.5::DOUBLE), 'b': bin}) + 0.5::DOUBLE) * 50")} AS length FROM m GROUP BY a""")
def decorrelation(spark: SparkSession, sf: str) -> DataFrame:
    own, sites = nations(spark, sf)
    return rounded(R.decorrelation_length(own.where("st = 'O'"), sites, 500, 0.5, 10), "length")


GRID = """WITH g AS (SELECT site, (month(time) - 1)::INTEGER AS y, (isodow(time) - 1)::INTEGER AS x, avg(value) AS value FROM hist GROUP BY ALL), s AS (SELECT DISTINCT site FROM g), full_ AS (SELECT s.site, y, x, coalesce(value, 0) AS value FROM s CROSS JOIN (SELECT unnest(range(12))::INTEGER AS y) CROSS JOIN (SELECT unnest(range(7))::INTEGER AS x) LEFT JOIN g USING (site, y, x)),
    cy AS (SELECT p AS y, k AS i, CASE WHEN k = 0 THEN sqrt(1 / 12.0::DOUBLE) ELSE sqrt(2 / 12.0::DOUBLE) END * cos(pi() * (2 * p + 1) * k / 24) AS c FROM (SELECT unnest(range(12)) AS p), (SELECT unnest(range(12)) AS k)),
    cx AS (SELECT p AS x, k AS j, CASE WHEN k = 0 THEN sqrt(1 / 7.0::DOUBLE) ELSE sqrt(2 / 7.0::DOUBLE) END * cos(pi() * (2 * p + 1) * k / 14) AS c FROM (SELECT unnest(range(7)) AS p), (SELECT unnest(range(7)) AS k)),
    w AS (SELECT site, i, j, sum(value * cy.c * cx.c) AS w FROM full_ JOIN cy USING (y) JOIN cx USING (x) GROUP BY ALL)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    own = Series(spark, sf).hist.groupBy("site", (F.month("time") - 1).alias("y"), F.weekday("time").alias("x")).agg(F.avg("value").alias("value"))
    cells = own.select("site").distinct().select("site", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y")).select("site", "y", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("x"))
    return cells.join(own, ["site", "y", "x"], "left").fillna(0.0, ["value"])


@query("spectral_variance", f"{GRID}, b AS (SELECT site, floor(sqrt((i / 12.0::DOUBLE) ** 2 + (j / 7.0::DOUBLE) ** 2) / (1 / 7.0::DOUBLE) + 1e-9) AS k, w FROM w) SELECT site, {R6('k * (1 / 7.0::DOUBLE)')} AS wavenumber, {R6('sum(w * w) / 84')} AS variance FROM b WHERE k > 0 AND k <= 7 GROUP BY site, k")
def spectral_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.spectral_variance(grid(spark, sf), (12, 7), by=BY), "wavenumber", "variance")


@query("spectral_filter", f"""{GRID}, a AS (SELECT *, sqrt((i / 12.0::DOUBLE) ** 2 + (j / 7.0::DOUBLE) ** 2) AS al FROM w), m AS (SELECT site, i, j, w * CASE WHEN al <= 0.3 THEN 1 WHEN al >= 0.8 THEN 0 ELSE cos((al - 0.3::DOUBLE) / 0.5::DOUBLE * (pi() / 2)) ** 2 END AS w FROM a)
    SELECT site, y::INTEGER AS y, x::INTEGER AS x, round(sum(w * cy.c * cx.c), 5) + 0.0 AS value FROM m JOIN cy USING (i) JOIN cx USING (j) GROUP BY site, y, x""")
def spectral_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.spectral_filter(grid(spark, sf), (12, 7), 0.3, 0.8, BY), "value", digits=5)


# several variables, tails

@query("pca_covariance", f"SELECT site, {R6('covar_samp(value, qty)')} AS c_vq, {R6('var_samp(value)')} AS c_vv, {R6('var_samp(qty)')} AS c_qq FROM ref GROUP BY site")
def pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Series(spark, sf).ref.groupBy("site").agg(F.covar_samp("value", "qty").alias("c_vq"), F.var_samp("value").alias("c_vv"), F.var_samp("qty").alias("c_qq")), "c_vq", "c_vv", "c_qq")


VARIABLES = ["value", "qty"]


def multivariate(name: str, f, **options) -> None:
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = Series(spark, sf)
        frames = [s.ref, s.hist] if f is V.otc else [s.ref, s.hist, s.sim]
        return rounded(f(*frames, VARIABLES, by=BY, **options), *VARIABLES, digits=4)


def axes_sql(table: str, name: str) -> str:
    """Table `name` of principal directions u, v (first) and -v, u, and the spreads s1, s2 along them, of value and qty."""
    return f"""{name}_c AS (SELECT site, var_samp(value) AS a, covar_samp(value, qty) AS b, var_samp(qty) AS d, avg(value) AS m0, avg(qty) AS m1 FROM {table} GROUP BY site),
    {name}_e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM {name}_c),
    {name} AS (SELECT site, m0, m1, sqrt(l1) AS s1, sqrt(l2) AS s2, b / sqrt(b * b + (l1 - a) ** 2) AS u, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS v FROM {name}_e)"""


# of the four ways to point the axes the one that comes nearest to leaving a point where it is
@query("principal_components", f"""WITH {axes_sql('ref', 'r')}, {axes_sql('hist', 'h')}, g AS (SELECT * FROM (SELECT unnest([-1, 1]) AS g1) CROSS JOIN (SELECT unnest([-1, 1]) AS g2)),
    t AS (SELECT r.site, r.m0, r.m1, g1 * r.s1 / h.s1 * r.u * h.u + g2 * r.s2 / h.s2 * r.v * h.v AS t00, g1 * r.s1 / h.s1 * r.u * h.v - g2 * r.s2 / h.s2 * r.v * h.u AS t01, g1 * r.s1 / h.s1 * r.v * h.u - g2 * r.s2 / h.s2 * r.u * h.v AS t10, g1 * r.s1 / h.s1 * r.v * h.v + g2 * r.s2 / h.s2 * r.u * h.u AS t11 FROM r JOIN h USING (site), g),
    best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY site ORDER BY (t00 - 1) ** 2 + t01 ** 2 + t10 ** 2 + (t11 - 1) ** 2) = 1),
    x AS (SELECT site, time, value - avg(value) OVER (PARTITION BY site) AS x0, qty - avg(qty) OVER (PARTITION BY site) AS x1 FROM sim)
    SELECT site, time, round(m0 + t00 * x0 + t01 * x1 + 3.7e-10, 4) + 0.0 AS value, round(m1 + t10 * x0 + t11 * x1 + 3.7e-10, 4) + 0.0 AS qty FROM x JOIN best USING (site)""")
def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    model = A.train("principal_components", s.ref, s.hist, variables=VARIABLES, by=BY)
    return rounded(model.adjust(s.sim), *VARIABLES, digits=4)


multivariate("npdf_transform", V.npdf_transform)
multivariate("mbcn", V.mbcn)
multivariate("mbcn_5d", V.mbcn, group="5D", window=7)
multivariate("otc", V.otc, bin_width=[40.0, 60.0])
multivariate("dotc", V.dotc, bin_width=[40.0, 60.0])


@query("extreme_values")
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(spark, sf)
    scen = A.train("eqm", s.ref, s.hist, by=BY).adjust(s.sim).select("site", "time", F.col("scen").alias("value"))
    model = A.train("extreme_values", s.ref, s.hist, cluster_thresh=120.0, q_thresh=0.9, by=BY)
    return rounded(model.adjust(s.sim, scen=scen), "value", digits=4)
