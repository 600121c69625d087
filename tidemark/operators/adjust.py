"""Univariate adjustments: train on (ref, hist), apply to sim.

A trained model is a small table, one row a site and group, with arrays over the quantile nodes, and a
dict of parameters. Training is one aggregate a series; applying is one join with the small table and an
array look-up inside the row, so sim is never shuffled by the model.

Series are long DataFrames: site columns `by`, `time`, and one value column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions import columns as C
from tidemark.functions import provenance as V
from tidemark.functions import units as U
from tidemark.operators import detrend as D
from tidemark.operators import processing as P
from tidemark.operators import stats
from tidemark.operators.grouping import Grouper, broadcast_groups, cyclic, grouped, with_bends


@dataclass
class Model:
    """What train() gives: parameters, and a table by site and group."""

    method: str
    params: dict
    table: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """The tables as Parquet and the parameters as JSON text, all by Spark's own writers."""
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        for name, df in self.extra.items():
            df.write.mode("overwrite").parquet(f"{path}/extra/{name}")
        spark = self.table.sparkSession
        own = json.dumps({"method": self.method, "params": self.params, "extra": sorted(self.extra)})
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        own = json.loads(spark.read.text(f"{path}/params").first()[0])
        return cls(own["method"], own["params"], spark.read.parquet(f"{path}/table"), {n: spark.read.parquet(f"{path}/extra/{n}") for n in own["extra"]})

    def adjust(self, sim: DataFrame | None = None, **options) -> DataFrame:
        """What the method gives for sim (methods that learn and apply in one take hist where there is none). Univariate methods add `scen`, with units and a line of history in its metadata, and with
        the option extra_output the columns that led to it; with as_dataset only sites, time and what was added come back."""
        value = self.params.get("value")
        if sim is None:
            return _method(self.method)[1](self, **options)
        if value in sim.columns:
            sim = matched(sim, value, self.params.get("units"))
        out = _method(self.method)[1](self, sim, **options)
        if "scen" not in out.columns or value not in sim.columns:
            return out
        if not V.option("extra_output"):
            out = out.drop(*(set(EXTRA) - set(sim.columns)))
        if V.option("as_dataset"):
            out = out.drop(*(set(sim.columns) - {*self.params.get("by", ()), "time"}))
        given = {k: v for k, v in self.params.items() if k in ("nquantiles", "kind", "group", "window", "thresh")}
        what = V.call(self.method, **given) + "." + V.call("adjust", **{k: v for k, v in options.items() if isinstance(v, (str, int, float, bool))})
        out = V.attach(out, "scen", **V.attributes(sim, value), bias_adjustment=what)
        return V.record(out, "scen", what)


#: Columns that adjustments add besides `scen`.
EXTRA = ("af", "sim_q", "trend", "hist_thresh")


def matched(df: DataFrame, value: str, unit: str | None) -> DataFrame:
    """df with the value in that unit; either both or none have one."""
    own = V.attributes(df, value).get("units")
    if (own is None) != (unit is None):
        raise ValueError(f"{value} has units {own!r}, where {unit!r} is asked for")
    if own is None or own == unit:
        return df
    meta = V.attributes(df, value) | {"units": unit}
    return df.withColumn(value, U.convert(F.col(value), own, unit).alias(value, metadata=meta))


#: What methods ask of ref and hist: the same times. Others take any.
SAME_TIMES = ("mbcn",)


def checked(method: str, ref: DataFrame, hist: DataFrame, params: dict) -> tuple[DataFrame, DataFrame, dict]:
    """ref, hist in ref's units, and parameters, or a ValueError that says what is wrong with them."""
    values = list(params["variables"]) if "variables" in params else [params.get("value", "value")]
    sites = list(params.get("by", ()))
    for name, df in (("ref", ref), ("hist", hist)):
        if missing := {*sites, "time", *values} - set(df.columns):
            raise ValueError(f"{name} has no columns {sorted(missing)}")
        for v in values:
            if not isinstance(df.schema[v].dataType, NumericType):
                raise ValueError(f"{v} of {name} isn't a number")
    for v in values:
        hist = matched(hist, v, V.attributes(ref, v).get("units"))
    if (thresh := params.get("thresh")) is not None and isinstance(thresh, str):
        params = params | {"thresh": U.quantity(thresh, V.attributes(ref, values[0])["units"])}
    if method in SAME_TIMES:
        a, b = (df.select(*sites, "time").distinct() for df in (ref, hist))
        if not a.exceptAll(b).unionAll(b.exceptAll(a)).isEmpty():
            raise ValueError("ref and hist have different times")
    return ref, hist, params


def _method(name: str) -> tuple[Callable, Callable]:
    if name not in METHODS:
        from tidemark.operators import multivariate  # noqa: F401  registers its methods

    if name not in METHODS:
        raise ValueError(f"method {name!r} isn't one of {sorted(METHODS)}")
    return METHODS[name]


def train(method: str, ref: DataFrame, hist: DataFrame, **params) -> Model:
    """A Model of the method, after the checks of checked(). ref and hist may carry units in the metadata of their values."""
    fit = _method(method)[0]
    if method in BUILT_IN:
        ref, hist, params = checked(method, ref, hist, params)
    model = fit(ref, hist, **params)
    value = model.params.get("value")
    if value in ref.columns and (unit := V.attributes(ref, value).get("units")) is not None:
        model.params["units"] = unit
    return model


def _prepared(ref: DataFrame, hist: DataFrame, params: dict) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Jitter below, jitter above, frequency adaptation of hist, in this order."""
    by, value = params["by"], params["value"]
    low, high, top = (params.get(k) for k in ("jitter_under_thresh_value", "jitter_over_thresh_value", "jitter_over_thresh_upper_bnd"))
    if (high is None) != (top is None):
        raise ValueError("jitter_over_thresh_value and jitter_over_thresh_upper_bnd go together")
    if low is not None or high is not None:
        ref, hist = (P.jitter(x, value, lower=low, upper=high, maximum=top, keys=[*by, "time"], seed=s) for x, s in ((ref, 11), (hist, 13)))
    if (thresh := params.get("adapt_freq_thresh")) is None:
        return ref, hist, None
    if params["sites"] != by:
        raise NotImplementedError("frequency adaptation doesn't take series together")
    adapted, shares = P.adapt_freq(ref, hist, Grouper(params["group"], params["window"]), thresh, by, value)
    return ref, adapted.drop("grp"), shares


def _quantile_table(df: DataFrame, params: dict, name: str) -> DataFrame:
    g = Grouper(params["group"], params["window"])
    return grouped(df, g, params["by"]).groupBy(*params["sites"], "grp").agg(C.quantiles(params["value"], _nodes(params["nquantiles"])).alias(name))


def _nodes(n: int | Sequence[float]) -> list[float]:
    return C.nodes(n) if isinstance(n, int) else list(n)


def _params(nquantiles: int, kind: str, group: str | Grouper, by: Sequence[str], value: str, more: dict) -> dict:
    g = Grouper.of(group)
    unknown = set(more) - {"adapt_freq_thresh", "jitter_under_thresh_value", "jitter_over_thresh_value", "jitter_over_thresh_upper_bnd", "max_tail_factor"}
    if unknown:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    if not isinstance(nquantiles, int) and not all(0 <= q <= 1 for q in nquantiles):
        raise ValueError("quantiles lie from 0 to 1")
    return {"nquantiles": nquantiles if isinstance(nquantiles, int) else sorted(nquantiles), "kind": C.check_kind(kind), "group": g.group, "window": g.window, "by": list(by), "sites": g.sites(by), "value": value, **more}


def train_eqm(ref: DataFrame, hist: DataFrame, *, nquantiles: int = 20, kind: str = "+", group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value", **more) -> Model:
    """Empirical quantile mapping: factors that bring the quantiles of hist to those of ref, by group."""
    params = _params(nquantiles, kind, group, by, value, more)
    raw = _quantile_table(hist, params, "hist_q_raw") if params.get("max_tail_factor") is not None else None
    ref, hist, shares = _prepared(ref, hist, params)
    keys = [*params["sites"], "grp"]
    table = _quantile_table(ref, params, "ref_q").join(_quantile_table(hist, params, "hist_q"), keys)
    table = table.select(*keys, "hist_q", F.zip_with("hist_q", "ref_q", lambda h, r: C.correction(h, r, kind)).alias("af"))
    if raw is not None:
        table = table.join(raw, keys)
    return Model("eqm", params, table if shares is None else table.join(shares, keys, "left"))


def train_qdm(ref: DataFrame, hist: DataFrame, **params) -> Model:
    model = train_eqm(ref, hist, **params)
    return Model("qdm", model.params, model.table)


def train_dqm(ref: DataFrame, hist: DataFrame, *, nquantiles: int = 20, kind: str = "+", group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value", **more) -> Model:
    """As train_eqm() on series freed of their means, and `scaling`, the factor between the means."""
    params = _params(nquantiles, kind, group, by, value, more)
    raw = _quantile_table(hist, params, "hist_q_raw") if params.get("max_tail_factor") is not None else None
    ref, hist, shares = _prepared(ref, hist, params)
    keys = [*params["sites"], "grp"]

    def free(df: DataFrame, name: str) -> DataFrame:
        """Quantiles of the anomalies of each group: those of the values, corrected by their mean, as correcting keeps the order."""
        own = grouped(df, Grouper(params["group"], params["window"]), params["by"]).groupBy(*keys).agg(C.quantiles(value, _nodes(nquantiles)).alias("_q"), F.avg(value).alias(f"_mean_{name}"))
        anomalies = F.transform("_q", lambda q: C.corrected(q, C.inverse(F.col(f"_mean_{name}"), kind), kind))
        # a negative mean turns the order round where the kind is *
        return own.select(*keys, f"_mean_{name}", F.when(F.lit(kind == "*") & (F.col(f"_mean_{name}") < 0), F.reverse(anomalies)).otherwise(anomalies).alias(f"{name}_q"))

    table = free(ref, "ref").join(free(hist, "hist"), keys)
    table = table.select(*keys, "hist_q", F.zip_with("hist_q", "ref_q", lambda h, r: C.correction(h, r, kind)).alias("af"), C.correction(F.col("_mean_hist"), F.col("_mean_ref"), kind).alias("scaling"))
    if raw is not None:
        table = table.join(raw, keys)
    return Model("dqm", params, table if shares is None else table.join(shares, keys, "left"))


def interpolate(df: DataFrame, table: DataFrame, x: str, xq: Column | str, yq: str, group: str | Grouper, by: Sequence[str] = (), interp: str = "nearest", extrapolation: str = "constant", out: str = "af", same_knots: bool = False) -> DataFrame:
    """df with `out`: yq at x in the group of each row.

    nearest: over all groups of a site, the knot nearest in the plane of (x, group number), as neighbouring
    groups are one apart there, the groups being cyclic; of equally near ones that of the least group,
    then quantile. Values beyond the knots of their own group get its end factors, or NULL. same_knots: all
    groups share their knots, so that one's own group always is as near as any.
    linear, cubic: between the knots of both neighbouring groups, cubic by a spline a group, then linearly
    between these groups. Knots that meet are one knot of a spline.
    """
    g = Grouper.of(group)
    constant = extrapolation == "constant"
    if extrapolation not in ("constant", "nan"):
        raise ValueError("extrapolation is constant or nan")
    if interp not in ("nearest", "linear", "cubic"):
        raise ValueError("interp is nearest, linear or cubic")
    knots = table.select(*by, "grp", (F.col(xq) if isinstance(xq, str) else xq).alias("_xq"), F.col(yq).alias("_yq"))
    look_up = lambda i: C.linear(F.col(x), F.col(f"_x{i}"), F.col(f"_y{i}"), constant)
    if interp == "cubic":
        knots = with_bends(knots)
        look_up = lambda i: C.cubic(F.col(x), F.col(f"_x{i}")["x"], F.col(f"_x{i}")["y"], F.col(f"_x{i}")["m"], constant)
    value = F.col(x)
    if g.group == "time" or interp == "nearest":
        own = df.withColumn("grp", g.key()).join(knots, [*by, "grp"], "left")
        if interp == "cubic":
            return own.withColumn("_x0", F.col("_xq")).withColumn(out, look_up(0)).drop("_xq", "_yq", "_x0", "grp")
        first, last = F.get("_xq", F.lit(0)), F.get("_xq", F.size("_xq") - 1)
        ends = lambda inner: F.when(value < first, F.get("_yq", F.lit(0)) if constant else None).when(value > last, F.get("_yq", F.size("_yq") - 1) if constant else None).otherwise(inner)
        if interp == "linear":
            return own.withColumn(out, C.linear(value, F.col("_xq"), F.col("_yq"), constant)).drop("_xq", "_yq", "grp")
        if g.group == "time" or same_knots:
            return own.withColumn(out, ends(C.nearest(value, F.col("_xq"), F.col("_yq")))).drop("_xq", "_yq", "grp")
        # knots of all groups of a site, cyclic ones too, in order of group and quantile
        one = F.transform(F.arrays_zip("_xq", "_yq"), lambda k: F.struct(k["_xq"].alias("x"), k["_yq"].alias("y")))
        flat = cyclic(knots, g).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("grp").alias("g"), one.alias("k")))).alias("_sets"))
        own = own.join(flat, list(by), "left") if by else own.crossJoin(F.broadcast(flat))
        # the nearest knot of each group by its place among the knots, then the nearest of these
        def best(s: Column) -> Column:
            xs = F.transform(s["k"], lambda k: k["x"])
            i = F.size(F.filter(F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: (a + b) / 2), lambda m: m < value))
            d = F.pow(value - F.get(s["k"], i)["x"], 2) + F.pow((s["g"] - F.col("grp")).cast("double"), 2)
            return F.struct(d.alias("d"), s["g"].alias("g"), F.get(s["k"], i)["y"].alias("y"))

        # groups stand a whole number apart: one further off than the nearest knot of one's own group can't hold a nearer one
        reach = F.coalesce(F.pow(value - C.nearest(value, F.col("_xq"), F.col("_xq")), 2), F.lit(float("inf")))
        inner = F.array_min(F.transform(F.filter("_sets", lambda s: F.pow((s["g"] - F.col("grp")).cast("double"), 2) <= reach), best))["y"]
        return own.withColumn(out, F.when(value.isNotNull(), ends(inner))).drop("_xq", "_yq", "_sets", "grp")
    padded = cyclic(knots, g)
    own = df.withColumn("_index", g.index()).withColumn("_low", F.floor("_index").cast("int"))
    own = own.join(padded.select(*by, F.col("grp").alias("_low"), F.col("_xq").alias("_x0"), F.col("_yq").alias("_y0")), [*by, "_low"], "left")
    own = own.withColumn("_high", F.col("_low") + 1).join(padded.select(*by, F.col("grp").alias("_high"), F.col("_xq").alias("_x1"), F.col("_yq").alias("_y1")), [*by, "_high"], "left")
    part = F.col("_index") - F.col("_low")
    low, high = look_up(0), look_up(1)
    return own.withColumn(out, F.when(part == 0, low).otherwise(low + part * (high - low))).drop("_index", "_low", "_high", "_x0", "_x1", "_y0", "_y1")


def _readied(model: Model, sim: DataFrame) -> DataFrame:
    """sim after frequency adaptation, and `_keep` where the tail factor leaves values as they are."""
    p = model.params
    if p.get("adapt_freq_thresh") is not None:
        sim = P.adapt_with(sim, model.table, p["group"], p["adapt_freq_thresh"], p["by"], p["value"], seed=17).drop("grp")
    if (most := p.get("max_tail_factor")) is not None:
        ends = model.table.select(*p["sites"], "grp", F.element_at("hist_q_raw", -1).alias("_end"))
        sim = broadcast_groups(sim, ends, p["group"], "_end", p["sites"], out="_end")
        return sim.withColumn("_keep", F.coalesce(F.col(p["value"]) > most * F.col("_end"), F.lit(False))).drop("_end")
    return sim.withColumn("_keep", F.lit(False))


def adjust_eqm(model: Model, sim: DataFrame, interp: str = "nearest", extrapolation: str = "constant") -> DataFrame:
    """sim with `af` and `scen`."""
    p = model.params
    own = interpolate(_readied(model, sim), model.table, p["value"], "hist_q", "af", p["group"], p["sites"], interp, extrapolation)
    return own.withColumn("scen", F.when(F.col("_keep"), F.col(p["value"])).otherwise(C.corrected(F.col(p["value"]), F.col("af"), p["kind"]))).drop("_keep")


def adjust_qdm(model: Model, sim: DataFrame, interp: str = "nearest", extrapolation: str = "constant", rank_window: bool = False) -> DataFrame:
    """sim with `sim_q`, its rank within its group, `af` and `scen`. rank_window ranks within the windowed group."""
    p = model.params
    own = grouped(_readied(model, sim), Grouper(p["group"], p["window"] if rank_window else 1), p["by"])
    own = stats.percent_rank(own, p["value"], [*p["sites"], "grp"], "sim_q").where("main").drop("grp", "main")
    knots = F.array(*map(F.lit, _nodes(p["nquantiles"])))
    own = interpolate(own, model.table, "sim_q", knots, "af", p["group"], p["sites"], interp, extrapolation, same_knots=True)
    return own.withColumn("scen", F.when(F.col("_keep"), F.col(p["value"])).otherwise(C.corrected(F.col(p["value"]), F.col("af"), p["kind"]))).drop("_keep")


def adjust_dqm(model: Model, sim: DataFrame, interp: str = "nearest", extrapolation: str = "constant", detrend: int | Callable[[DataFrame], DataFrame] = 1) -> DataFrame:
    """sim with `trend`, `af` and `scen`. detrend: the degree of a polynomial by group, or a function that adds `trend`."""
    p = model.params
    value, kind, by, sites = p["value"], p["kind"], p["by"], p["sites"]
    own = broadcast_groups(_readied(model, sim), model.table, p["group"], "scaling", sites, interp=interp if interp == "linear" and p["group"] not in ("time", "time.week") else "nearest", out="_scaling")
    own = own.withColumn("_sim", F.col(value)).withColumn(value, C.corrected(F.col(value), F.col("_scaling"), kind))
    own = detrend(own) if callable(detrend) else D.polynomial(own, p["group"], kind, detrend, by, value)
    own = own.withColumn(value, C.corrected(F.col(value), C.inverse(F.col("trend"), kind), kind))
    own = interpolate(own, model.table, value, "hist_q", "af", p["group"], sites, interp, extrapolation)
    scen = C.corrected(C.corrected(F.col(value), F.col("af"), kind), F.col("trend"), kind)
    return own.withColumn("scen", F.when(F.col("_keep"), F.col("_sim")).otherwise(scen)).withColumn(value, F.col("_sim")).drop("_sim", "_scaling", "_keep")


def train_scaling(ref: DataFrame, hist: DataFrame, *, group: str | Grouper = "time", kind: str = "+", by: Sequence[str] = (), value: str = "value") -> Model:
    g = Grouper.of(group)
    sites = g.sites(by)
    params = {"group": g.group, "window": g.window, "kind": C.check_kind(kind), "by": list(by), "sites": sites, "value": value}
    mean = lambda df, name: grouped(df, g, by).groupBy(*sites, "grp").agg(F.avg(value).alias(name))
    return Model("scaling", params, mean(ref, "_r").join(mean(hist, "_h"), [*sites, "grp"]).select(*sites, "grp", C.correction(F.col("_h"), F.col("_r"), kind).alias("af")))


def adjust_scaling(model: Model, sim: DataFrame, interp: str = "nearest") -> DataFrame:
    p = model.params
    own = broadcast_groups(sim, model.table, p["group"], "af", p["sites"], interp=interp, out="af")
    return own.withColumn("scen", C.corrected(F.col(p["value"]), F.col("af"), p["kind"]))


def train_loci(ref: DataFrame, hist: DataFrame, *, thresh: float, group: str | Grouper = "time", by: Sequence[str] = (), value: str = "value") -> Model:
    """Local intensity scaling: the threshold of hist that matches that of ref, and the ratio of mean intensities above them."""
    g = Grouper.of(group)
    keys = [*g.sites(by), "grp"]
    params = {"group": g.group, "window": g.window, "thresh": thresh, "by": list(by), "sites": g.sites(by), "value": value}
    r, h = grouped(ref, g, by), grouped(hist, g, by)
    limit = stats.map_cdf(h.select(*keys, value), r.select(*keys, value), thresh, keys, value, "hist_thresh")
    wet = lambda df, t: F.avg(F.when(F.col(value) >= t, F.col(value)))
    above = r.groupBy(*keys).agg(wet(r, F.lit(thresh)).alias("_r")).join(h.join(limit, keys).groupBy(*keys, "hist_thresh").agg(wet(h, F.col("hist_thresh")).alias("_h")), keys)
    return Model("loci", params, above.select(*keys, "hist_thresh", F.try_divide(F.col("_r") - thresh, F.col("_h") - F.col("hist_thresh")).alias("af")))


def adjust_loci(model: Model, sim: DataFrame, interp: str = "linear") -> DataFrame:
    p = model.params
    if p["group"] in ("time", "time.week"):
        interp = "nearest"
    own = broadcast_groups(sim, model.table, p["group"], "af", p["sites"], interp=interp, out="af")
    own = broadcast_groups(own, model.table, p["group"], "hist_thresh", p["sites"], interp=interp, out="hist_thresh")
    return own.withColumn("scen", F.greatest(F.lit(0.0), F.col("af") * (F.col(p["value"]) - F.col("hist_thresh")) + p["thresh"]))


METHODS: dict[str, tuple[Callable, Callable]] = {
    "eqm": (train_eqm, adjust_eqm),
    "qdm": (train_qdm, adjust_qdm),
    "dqm": (train_dqm, adjust_dqm),
    "scaling": (train_scaling, adjust_scaling),
    "loci": (train_loci, adjust_loci),
}


BUILT_IN = (*METHODS, "principal_components", "mbcn", "extreme_values", "npdf_transform", "otc", "dotc")


def register(name: str, fit: Callable, predict: Callable) -> None:
    """Adds a method of one's own: fit(ref, hist, **params) -> Model, predict(model, sim, **options) -> DataFrame."""
    if name in METHODS:
        raise ValueError(f"there is a method {name!r} already")
    METHODS[name] = (fit, predict)
