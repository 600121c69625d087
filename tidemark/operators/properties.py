"""Properties of series, one row a site and group, and the measure that compares each by default.

Every property takes a long DataFrame with site columns `by`, `time` and a value column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.kernels import fit_gev, gev_ppf, t_pvalue
from tidemark.operators import processing as P
from tidemark.operators import stats
from tidemark.operators.grouping import Grouper, grouped

#: Property: default measure.
MEASURES = {"mean": "bias", "var": "ratio", "std": "ratio", "skewness": "bias", "quantile": "bias", "spell_length_distribution": "bias", "threshold_count": "bias", "acf": "bias", "annual_cycle_amplitude": "bias", "relative_annual_cycle_amplitude": "ratio", "annual_cycle_phase": "circular_bias", "annual_cycle_asymmetry": "bias", "annual_cycle_minimum": "bias", "annual_cycle_maximum": "bias", "mean_annual_range": "bias", "mean_annual_relative_range": "ratio", "mean_annual_phase": "circular_bias", "corr_btw_var": "bias", "bivariate_spell_length_distribution": "bias", "bivariate_threshold_count": "bias", "relative_frequency": "bias", "transition_probability": "bias", "trend": "bias", "return_value": "bias", "spatial_correlogram": "bias", "decorrelation_length": "bias", "spectral_variance": "bias"}


def reduced(df: DataFrame, agg: Column, group: str | Grouper = "time", by: Sequence[str] = (), name: str = "out") -> DataFrame:
    return grouped(df, group, by).groupBy(*by, "grp").agg(agg.alias(name))


def mean(df: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return reduced(df, F.avg(value), group, by, "mean")


def var(df: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Of the population."""
    return reduced(df, F.var_pop(value), group, by, "var")


def std(df: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return reduced(df, F.stddev_pop(value), group, by, "std")


def skewness(df: DataFrame, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return reduced(df, F.skewness(value), group, by, "skewness")


def quantile(df: DataFrame, q: float = 0.98, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return reduced(df, F.percentile(value, q), group, by, "quantile")


def periods(time: Column, group: str) -> Column:
    """Start of the period that a time falls in when series are resampled by group."""
    t = time.cast("date")
    if group == "time":
        return F.trunc(t, "year")
    if group == "time.season":
        return F.add_months(F.trunc(F.add_months(t, 1), "quarter"), -1)
    return F.trunc(t, {"time.month": "month", "time.week": "week"}[group])


STATS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop}


def _spells(df: DataFrame, condition: Column, group: str | Grouper, by: Sequence[str], window: int, stat: str, stat_resample: str | None, resample_before_rl: bool, known: Column) -> DataFrame:
    """Lengths of runs of `window` steps or more, by `stat_resample` in each period (0 without a run), then by `stat` over the periods of a group."""
    g = Grouper.of(group, ("time", "time.season", "time.month"))
    own = df.withColumn("_known", known).withColumn("_cond", F.coalesce(condition, F.lit(False))).withColumn("_period", periods(F.col("time"), g.group))
    part = [*by, "_period"] if resample_before_rl else list(by)
    whole = own.groupBy(*by, "_period").agg(F.max(g.key()).alias("grp"))
    lengths = stats.runs(own, F.col("_cond"), part).where("run IS NOT NULL").groupBy(*part, "run").agg(F.count("*").alias("_n"), F.min("_period").alias("_p")).where(F.col("_n") >= window)
    lengths = lengths.groupBy(*by, F.col("_p").alias("_period")).agg(STATS[stat_resample or stat]("_n").cast("double").alias("_s"))
    firsts = own.groupBy(*by).agg(F.min_by("_known", "time").alias("_first"))
    out = whole.join(lengths, [*by, "_period"], "left").groupBy(*by, "grp").agg(STATS[stat](F.coalesce("_s", F.lit(0.0))).alias("_out"))
    out = out.join(firsts, list(by)) if by else out.crossJoin(F.broadcast(firsts))
    return out.select(*by, "grp", F.when(F.col("_first"), F.col("_out")).alias("spell"))


def _limited(df: DataFrame, method: str, thresh: float, by: Sequence[str], group: str | Grouper, value: str, name: str) -> DataFrame:
    """df with the threshold as a column: an amount, or a quantile of the group."""
    if method == "amount":
        return df.withColumn(name, F.lit(float(thresh)))
    if method != "quantile":
        raise ValueError(f"method is amount or quantile, not {method!r}")
    keyed = df.withColumn("_g", Grouper.of(group).key())
    limits = keyed.groupBy(*by, "_g").agg(F.percentile(value, float(thresh)).alias(name))
    return keyed.join(limits, [*by, "_g"], "left").drop("_g")


def spell_length_distribution(df: DataFrame, method: str = "amount", op: str = ">=", thresh: float = 1.0, window: int = 1, stat: str = "mean", stat_resample: str | None = None, group: str | Grouper = "time", resample_before_rl: bool = True, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    own = _limited(df, method, thresh, by, group, value, "_t")
    return _spells(own, C.compare(op, F.col(value), F.col("_t"), [">", "<", ">=", "<="]), group, by, window, stat, stat_resample, resample_before_rl, F.col(value).isNotNull())


def threshold_count(df: DataFrame, **options) -> DataFrame:
    return spell_length_distribution(df, **{"stat_resample": "sum", **options, "window": 1})


def bivariate_spell_length_distribution(df: DataFrame, values: tuple[str, str], methods: tuple[str, str] = ("amount", "amount"), ops: tuple[str, str] = (">=", ">="), threshs: tuple[float, float] = (1.0, 1.0), window: int = 1, stat: str = "mean", stat_resample: str | None = None, group: str | Grouper = "time", resample_before_rl: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Runs on which both conditions hold."""
    own = df
    for i in range(2):
        own = _limited(own, methods[i], threshs[i], by, group, values[i], f"_t{i}")
    both = C.compare(ops[0], F.col(values[0]), F.col("_t0")) & C.compare(ops[1], F.col(values[1]), F.col("_t1"))
    return _spells(own, both, group, by, window, stat, stat_resample, resample_before_rl, F.col(values[0]).isNotNull() & F.col(values[1]).isNotNull())


def bivariate_threshold_count(df: DataFrame, values: tuple[str, str], **options) -> DataFrame:
    return bivariate_spell_length_distribution(df, values, **{"stat_resample": "sum", **options, "window": 1})


def acf(df: DataFrame, lag: int = 1, group: str | Grouper = "time.season", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Autocorrelation within each period, averaged over the periods of a group."""
    g = Grouper.of(group, ("time.season", "time.month"))
    own = df.withColumn("_period", periods(F.col("time"), g.group)).withColumn("grp", g.key())
    part = Window.partitionBy(*by, "_period")
    own = own.withColumn("_d", F.col(value) - F.avg(value).over(part)).withColumn("_l", F.lead("_d", lag).over(part.orderBy("time")))
    each = own.groupBy(*by, "_period", "grp").agg(F.try_divide(F.coalesce(F.sum(F.col("_d") * F.col("_l")), F.lit(0.0)), F.sum(F.col("_d") * F.col("_d"))).alias("_r"))
    return each.groupBy(*by, "grp").agg(F.avg("_r").alias("acf"))


def annual_cycle(df: DataFrame, window: int = 31, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, doy, cycle): mean of each day of the year, smoothed round the year by complete windows."""
    days = df.groupBy(*by, F.dayofyear("time").alias("doy")).agg(F.avg(value).alias("_m"))
    if window <= 1:
        return days.withColumnRenamed("_m", "cycle")
    half = window // 2
    w = Window.partitionBy(*by)
    order = w.orderBy("doy")
    placed = days.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(w))
    copies = [placed.withColumn("_main", F.lit(True)), placed.where(F.col("_k") > F.col("_n") - half).withColumn("_k", F.col("_k") - F.col("_n")).withColumn("_main", F.lit(False)), placed.where(F.col("_k") <= half).withColumn("_k", F.col("_k") + F.col("_n")).withColumn("_main", F.lit(False))]
    wrapped = copies[0].unionByName(copies[1]).unionByName(copies[2])
    frame = w.orderBy("_k").rowsBetween(-half, window - 1 - half)
    smooth = F.when(F.count("_m").over(frame) == window, F.avg("_m").over(frame))
    return wrapped.withColumn("cycle", smooth).where("_main").select(*by, "doy", "cycle")


def annual_cycle_stat(df: DataFrame, stat: str, window: int = 31, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """absamp, relamp, phase, min, max or asymmetry of the annual cycle; the earliest day of equal ones."""
    high = F.min(F.when(F.col("cycle").isNotNull(), F.struct((-F.col("cycle")).alias("c"), "doy")))["doy"]
    low = F.min(F.when(F.col("cycle").isNotNull(), F.struct(F.col("cycle").alias("c"), "doy")))["doy"]
    out = {"absamp": F.max("cycle") - F.min("cycle"), "relamp": F.try_divide((F.max("cycle") - F.min("cycle")) * 100, F.avg("cycle")), "phase": high, "min": F.min("cycle"), "max": F.max("cycle"), "asymmetry": F.pmod(high - low, F.lit(365)) / 365}
    return annual_cycle(df, window, by, value).groupBy(*by).agg(out[stat].alias(stat))


def annual_statistic(df: DataFrame, stat: str, window: int = 31, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """absamp, relamp or phase of each year of the rolling mean, averaged over the years."""
    half = window // 2
    frame = Window.partitionBy(*by).orderBy("time").rowsBetween(-half, window - 1 - half)
    own = df.withColumn("_s", F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))) if window > 1 else df.withColumn("_s", F.col(value))
    top = F.min(F.when(F.col("_s").isNotNull(), F.struct((-F.col("_s")).alias("v"), "time")))["time"]
    each = {"absamp": F.max("_s") - F.min("_s"), "relamp": F.try_divide((F.max("_s") - F.min("_s")) * 100, F.avg("_s")), "phase": F.dayofyear(top)}
    return own.groupBy(*by, F.year("time").alias("_y")).agg(each[stat].alias("_v")).groupBy(*by).agg(F.avg("_v").alias(stat))


def corr_btw_var(df: DataFrame, values: tuple[str, str], corr_type: str = "Spearman", group: str | Grouper = "time", output: str = "correlation", by: Sequence[str] = ()) -> DataFrame:
    """Of pairs that are both known; Spearman's on average ranks. p-values come from the t distribution."""
    kind = corr_type.lower()
    if kind not in ("spearman", "pearson") or output not in ("correlation", "pvalue"):
        raise ValueError("corr_type is Pearson or Spearman, output correlation or pvalue")
    own = grouped(df, group, by).dropna(subset=list(values))
    part = [*by, "grp"]
    a, b = values
    if kind == "spearman":
        own = own.withColumn("_a", stats.average_rank(a, part)).withColumn("_b", stats.average_rank(b, part))
        a, b = "_a", "_b"
    out = own.groupBy(*part).agg(F.corr(a, b).alias("correlation"), F.count("*").alias("_n"))
    if output == "correlation":
        return out.drop("_n")

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_pvalue(x * math.sqrt((m - 2) / (1 - x * x)) if m > 2 and abs(x) < 1 else (math.inf if m > 2 else math.nan), m - 2) for x, m in zip(r, n)])

    return out.withColumn("pvalue", p("correlation", "_n")).drop("_n", "correlation")


def relative_frequency(df: DataFrame, op: str = ">=", thresh: float = 1.0, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows on which the condition holds, of all rows."""
    return reduced(df, F.sum(F.coalesce(C.compare(op, F.col(value), F.lit(thresh)), F.lit(False)).cast("long")) / F.count("*"), group, by, "frequency")


def transition_probability(df: DataFrame, initial_op: str = ">=", final_op: str = ">=", thresh: float = 1.0, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Share of steps that meet one condition and whose next step meets the other; the last step has none."""
    w = Window.partitionBy(*by).orderBy("time")
    own = df.withColumn("_next", F.lead(value).over(w)).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    firsts = df.groupBy(*by).agg(F.min_by(F.col(value).isNotNull(), "time").alias("_first"))
    hit = F.coalesce(C.compare(initial_op, F.col(value), F.lit(thresh)) & C.compare(final_op, F.col("_next"), F.lit(thresh)), F.lit(False))
    out = reduced(own.where(F.col("_k") < F.col("_n")), F.avg(hit.cast("double")), group, by, "probability")
    out = out.join(firsts, list(by)) if by else out.crossJoin(F.broadcast(firsts))
    return out.select(*by, "grp", F.when(F.col("_first"), F.col("probability")).alias("probability"))


def trend(df: DataFrame, group: str | Grouper = "time", output: str = "slope", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Least squares of the means of periods against their number; slope, intercept, rvalue, pvalue, stderr or intercept_stderr."""
    g = Grouper.of(group, ("time", "time.season", "time.month"))
    means = df.groupBy(*by, periods(F.col("time"), g.group).alias("_p"), g.key().alias("grp")).agg(F.avg(value).alias("_m"))
    own = means.withColumn("_k", (F.row_number().over(Window.partitionBy(*by, "grp").orderBy("_p")) - 1).cast("double"))
    out = own.groupBy(*by, "grp").agg(F.regr_slope("_m", "_k").alias("slope"), F.regr_intercept("_m", "_k").alias("intercept"), F.corr("_m", "_k").alias("rvalue"), F.count("_m").alias("_n"), F.var_pop("_k").alias("_vk"), F.var_pop("_m").alias("_vm"), F.avg("_k").alias("_mk"))
    err = F.sqrt(F.try_divide((1 - F.col("rvalue") * F.col("rvalue")) * F.col("_vm"), F.col("_vk") * (F.col("_n") - 2)))
    out = out.withColumn("stderr", err).withColumn("intercept_stderr", F.col("stderr") * F.sqrt(F.col("_vk") + F.col("_mk") * F.col("_mk")))

    if output == "pvalue":
        @F.pandas_udf("double")
        def p(slope: pd.Series, err: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([t_pvalue(s / e if e else math.inf, m - 2) for s, e, m in zip(slope, err, n)])

        out = out.withColumn("pvalue", p("slope", "stderr", "_n"))
    return out.select(*by, "grp", output)


def return_value(df: DataFrame, period: float = 20, op: str = "max", method: str = "ML", group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The value that a fitted extreme value distribution exceeds once in `period` periods; yearly extremes are an aggregate, the fit a kernel over them."""
    g = Grouper.of(group, ("time", "time.season", "time.month"))
    each = df.groupBy(*by, periods(F.col("time"), g.group).alias("_p"), g.key().alias("grp")).agg((F.max if op == "max" else F.min)(value).alias("_v"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "grp int", "return_value double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, "grp"]].head(1).copy()
        out["return_value"] = gev_ppf(1 - 1 / period, *fit_gev(pdf["_v"].to_numpy(float), method))
        return out

    return each.groupBy(*by, "grp").applyInPandas(fit, schema).withColumn("return_value", F.nanvl("return_value", F.lit(None).cast("double")))


#: Sites of a block; a cell of two blocks is one task's work.
SITES = 64


def pairwise_spearman(df: DataFrame, site: str = "site", value: str = "value", block: int = SITES) -> DataFrame:
    """(a, b, corr): rank correlation of each two sites, each series less the mean of all sites at each time.

    Pairs of sites are what is asked for. Sites are dealt out in cells of two blocks; a cell ranks the
    series that know all its times once and multiplies their ranks as matrices; where one misses times, the
    pair is ranked over the times that both know.
    """
    own = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy("time"))).where("_d IS NOT NULL").select(site, "time", "_d")
    n = max(1, -(-own.select(site).distinct().count() // block))
    own = own.withColumn("_b", F.pmod(F.xxhash64(site), F.lit(n)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = own.select(site, "time", "_d", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    kind = df.schema[site].dataType.simpleString()

    def centred(x: np.ndarray) -> np.ndarray:
        r = pd.DataFrame(x).rank(axis=1).to_numpy()
        r -= np.nanmean(r, axis=1, keepdims=True)
        return r

    def corr(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        wide = pdf.pivot(index=site, columns="time", values="_d").sort_index()
        of = pdf.groupby(site)["_b"].first().reindex(wide.index).to_numpy()
        x = wide.to_numpy(float)
        full = ~np.isnan(x).any(axis=1)
        r = np.zeros_like(x)
        if full.any():
            r[full] = centred(x[full])
        norm = np.sqrt((r * r).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (r @ r.T) / (norm[:, None] * norm[None, :])
            for a in range(len(x)):
                for b in range(len(x)) if not full[a] else np.flatnonzero(~full):
                    both = ~np.isnan(x[a]) & ~np.isnan(x[b])
                    p, q = centred(x[[a, b]][:, both]) if both.any() else (np.zeros(0), np.zeros(0))
                    out[a, b] = out[b, a] = (p @ q) / math.sqrt((p @ p) * (q @ q)) if (p @ p) * (q @ q) > 0 else np.nan
        a, b = np.nonzero((of[:, None] == i) & (of[None, :] == j) | (of[:, None] == j) & (of[None, :] == i))
        # of pairs that know no time in common there is no row
        met = np.array([full[k] and full[m] or (~np.isnan(x[k]) & ~np.isnan(x[m])).any() for k, m in zip(a, b)], bool)
        return pd.DataFrame({"a": wide.index.to_numpy()[a[met]], "b": wide.index.to_numpy()[b[met]], "corr": out[a[met], b[met]]})

    found = own.groupBy("_i", "_j").applyInPandas(corr, f"a {kind}, b {kind}, corr double")
    return found.withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def with_distances(pairs: DataFrame, sites: DataFrame, site: str = "site") -> DataFrame:
    """Pairs (a, b) with `km`: the places come by two equal joins."""
    one = lambda name, k: sites.select(F.col(site).alias(name), F.col("lon").alias(f"_lon{k}"), F.col("lat").alias(f"_lat{k}"))
    km = F.when(F.col("a") == F.col("b"), 0.0).otherwise(C.great_circle(F.col("_lon0"), F.col("_lat0"), F.col("_lon1"), F.col("_lat1")))
    return pairs.join(one("a", 0), "a").join(one("b", 1), "b").withColumn("km", km).drop("_lon0", "_lat0", "_lon1", "_lat1")


def distances(sites: DataFrame, site: str = "site") -> DataFrame:
    """(a, b, km) of all pairs of sites with `lon` and `lat`: the matrix that is asked for."""
    b = sites.select(F.col(site).alias("b"))
    return with_distances(sites.select(F.col(site).alias("a")).crossJoin(b), sites, site).select("a", "b", "km")


def _correlations(df: DataFrame, sites: DataFrame, site: str, value: str) -> DataFrame:
    """(a, b, corr, km) of pairs of sites."""
    return with_distances(pairwise_spearman(df, site, value), sites, site)


def spatial_correlogram(df: DataFrame, sites: DataFrame, bins: int | Sequence[float] = 100, site: str = "site", value: str = "value") -> DataFrame:
    """(distance, corr): mean correlation of the pairs in each bin; a number of bins between the least and the greatest distance, or their edges."""
    pairs = _correlations(df, sites, site, value).where("a < b")
    if isinstance(bins, int):
        ends = pairs.agg((F.min("km") * 0.9999).alias("_low"), (F.max("km") * 1.0001).alias("_high"))
        own = pairs.where("corr IS NOT NULL").crossJoin(F.broadcast(ends)).withColumn("_w", (F.col("_high") - F.col("_low")) / bins)
        own = own.withColumn("_bin", F.least(F.floor((F.col("km") - F.col("_low")) / F.col("_w")), F.lit(bins - 1)))
        return own.groupBy("_bin").agg((F.first("_low") + (F.col("_bin") + 0.5) * F.first("_w")).alias("distance"), F.avg("corr").alias("corr")).drop("_bin")
    edges = F.array(*(F.lit(float(e)) for e in sorted(bins)))
    at = F.size(F.filter(edges, lambda e: e < F.col("km")))  # bins hold their upper edge
    own = pairs.where("corr IS NOT NULL").withColumn("_bin", at).where((F.col("_bin") > 0) & (F.col("_bin") < len(bins)))
    return own.groupBy("_bin").agg(((F.get(edges, F.col("_bin") - 1) + F.get(edges, F.col("_bin"))) / 2).alias("distance"), F.avg("corr").alias("corr")).drop("_bin")


def decorrelation_length(df: DataFrame, sites: DataFrame, radius: float = 300, thresh: float = 0.5, bins: int = 100, site: str = "site", value: str = "value") -> DataFrame:
    """(site, length): the centre of the bin of distances whose mean correlation is nearest to the threshold."""
    width = radius / bins
    near = _correlations(df, sites, site, value).where(F.col("km") < radius).where("corr IS NOT NULL")
    binned = near.groupBy("a", F.floor(F.col("km") / width).alias("_bin")).agg(F.avg("corr").alias("_c"))
    best = F.min(F.struct(F.abs(F.col("_c") - thresh).alias("d"), "_bin"))["_bin"]
    return binned.groupBy(F.col("a").alias(site)).agg(((best + 0.5) * width).alias("length"))


def spectral_variance(df: DataFrame, sizes: tuple[int, int], delta: float | None = None, by: Sequence[str] = (), y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    """(by, wavenumber, variance): power of the cosine transform in bands of normalised wavenumber, or of wavelength where delta is given."""
    step = 1 / min(sizes)
    alpha = F.sqrt(F.pow(F.col("_i") / sizes[0], 2) + F.pow(F.col("_j") / sizes[1], 2))
    band = F.floor(alpha / step + 1e-9) * step
    out = P.dct(df, sizes, by, y, x, value).withColumn("wavenumber", band).where((F.col("wavenumber") > 0) & (F.col("wavenumber") <= 1 + 1e-9))
    out = out.groupBy(*by, "wavenumber").agg((F.sum(F.col("wave") * F.col("wave")) / (sizes[0] * sizes[1])).alias("variance"))
    return out if delta is None else out.withColumn("wavelength", 2 * delta / F.col("wavenumber"))


def first_eof(*args, **kwargs) -> DataFrame:
    raise RuntimeError("the first empirical orthogonal function isn't offered")
