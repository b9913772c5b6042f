"""Forecast evaluation and reporting.

Predictions are long: (ts, model, variant, y_true, y_pred). Every metric is one
grouped aggregation; MAPE skips zero actuals (their count is returned as
``n_zero_actual``) instead of producing an infinite value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast.functions.columns import clean_double, with_scalars
from flowcast.functions.fmt import fixed4, percent2
from flowcast.functions.weather import REPORT_RUSH_HOURS, extreme_weather, is_rush_hour
from flowcast.operators import ordered

METRICS = ("rmse", "mae", "r2", "mape")


def _metric_aggs(y: Column, p: Column) -> list[Column]:
    e = p - y
    n = F.count(e)
    sse = F.sum(e * e)
    var_n = F.var_pop(F.when(e.isNotNull(), y)) * n
    r2 = (F.when(var_n > 0, F.lit(1.0) - sse / var_n)
           .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        r2.alias("r2"),
        (F.avg(F.abs(F.try_divide(e, y))) * 100.0).alias("mape"),
        F.count_if(e.isNotNull() & (y == 0)).alias("n_zero_actual"),
    ]


def regression_metrics(preds: DataFrame, by: Sequence[str] = ("model", "variant"),
                       y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K1: n, RMSE, MAE, R2 (sklearn: 1 - SSE / (n var_pop(y)); zero-variance truth
    gives 1 if perfect else 0), MAPE in percent over non-zero actuals."""
    return preds.groupBy(*by).agg(*_metric_aggs(F.col(y), F.col(p)))


def errors(preds: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K2: error = prediction - truth."""
    return preds.withColumn("error", F.col(p) - F.col(y))


def combined_loss(preds: DataFrame, by: Sequence[str] = ("model", "variant"), eps: float = 1e-7,
                  y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """K3 + K4: the combined training loss 0.3 RMSE + 0.3 MAE + 0.2 * 0.01 MAPE_eps
    + 0.2 (1 - R2_eps), over whole groups (the training loop averaged it per batch);
    MAPE_eps divides by y + eps, R2_eps = 1 - SSE / (SST + eps)."""
    yt, yp = F.col(y), F.col(p)
    d = yt - yp
    g = preds.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        (F.avg(F.abs(F.try_divide(d, yt + F.lit(eps)))) * 100.0).alias("mape_eps"),
        F.sum(d * d).alias("_fc_sse"),
        (F.var_pop(yt) * F.count(yt)).alias("_fc_sst"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_fc_sse"), F.col("_fc_sst") + F.lit(eps))
    return g.select(*by, "rmse", "mae", "mape_eps", r2.alias("r2_eps"),
                    (0.3 * F.col("rmse") + 0.3 * F.col("mae") + 0.2 * F.col("mape_eps") * 0.01
                     + 0.2 * (F.lit(1.0) - r2)).alias("combined_loss"))


def _paired_metrics(metrics: DataFrame, model: str) -> DataFrame:
    """One row a model that has both variants: b_<metric> and e_<metric>."""
    pick = lambda v, m: F.max(F.when(F.col("variant") == v, F.col(m)))
    g = metrics.groupBy(model).agg(
        *[pick("baseline", m).alias(f"b_{m}") for m in METRICS], *[pick("enhanced", m).alias(f"e_{m}") for m in METRICS],
        F.count_if(F.col("variant") == "baseline").alias("_fc_nb"), F.count_if(F.col("variant") == "enhanced").alias("_fc_ne"))
    return g.where("_fc_nb > 0 and _fc_ne > 0").drop("_fc_nb", "_fc_ne")


def improvements(metrics: DataFrame, model: str = "model") -> DataFrame:
    """K5: per model, relative improvement in percent of RMSE, MAE and MAPE
    ((base - enh) / base * 100) and the R2 gain in points ((enh - base) * 100)."""
    j = _paired_metrics(metrics, model)
    rel = lambda m: clean_double(F.try_divide(F.col(f"b_{m}") - F.col(f"e_{m}"), F.col(f"b_{m}")) * 100.0)
    return j.select(model,
                    rel("rmse").alias("rmse_improvement"),
                    rel("mae").alias("mae_improvement"),
                    ((F.col("e_r2") - F.col("b_r2")) * 100.0).alias("r2_improvement"),
                    rel("mape").alias("mape_improvement"))


def best_model(imp: DataFrame, model: str = "model") -> DataFrame:
    """K6: model with the highest mean of RMSE, MAE and R2 improvement (MAPE not
    counted); ties go to the first model name."""
    score = (F.col("rmse_improvement") + F.col("mae_improvement") + F.col("r2_improvement")) / 3.0
    return (imp.select(model, score.alias("score"))
               .orderBy(F.col("score").desc(), F.col(model).asc()).limit(1))


def metrics_by_condition(preds: DataFrame, weather: DataFrame, ts: str = "ts",
                         rush_hours: Sequence[int] = REPORT_RUSH_HOURS) -> DataFrame:
    """K7: metrics per (model, variant, condition) for overall, extreme weather
    (PRCP>q90 or AWND>q90 or TMAX>q90 or TMIN<q10 over the weather table), its
    complement ``normal``, and rush hour. Conditions come from the weather row
    of the same timestamp."""
    from flowcast.operators.clean import quantiles
    thr = quantiles(weather, ["prcp", "awnd", "tmax", "tmin"], [0.1, 0.9])  # one distributed pass
    w, q = with_scalars(weather, thr, "_fc_q")
    w = w.select(ts, extreme_weather("prcp", "awnd", "tmax", "tmin", q["prcp_q90"], q["awnd_q90"],
                                           q["tmax_q90"], q["tmin_q10"]).alias("_fc_ext"))
    j = preds.join(w, ts, "left")
    tagged = j.select("*", F.explode(F.array(
        F.lit("overall"),
        F.when(F.col("_fc_ext") == 1, F.lit("extreme")),
        F.when(F.coalesce(F.col("_fc_ext"), F.lit(0)) == 0, F.lit("normal")),
        F.when(is_rush_hour(ts, rush_hours) == 1, F.lit("rush_hour")))).alias("condition"))
    tagged = tagged.where(F.col("condition").isNotNull())
    return tagged.groupBy("model", "variant", "condition").agg(*_metric_aggs(F.col("y_true"), F.col("y_pred")))


def performance_table(metrics: DataFrame, imp: DataFrame, model: str = "model") -> DataFrame:
    """K8: per model, formatted baseline/enhanced RMSE, MAE, R2 ('%.4f') and the
    improvements ('%.2f%%')."""
    cols = []
    for m in ("rmse", "mae", "r2"):
        cols += [fixed4(F.first(F.when(F.col("variant") == "baseline", F.col(m)), True)).alias(f"baseline_{m}"),
                 fixed4(F.first(F.when(F.col("variant") == "enhanced", F.col(m)), True)).alias(f"enhanced_{m}")]
    t = metrics.groupBy(model).agg(*cols)
    return t.join(imp.select(model, *[percent2(f"{m}_improvement").alias(f"{m}_improvement")
                                      for m in ("rmse", "mae", "r2")]), model)


def improvement_matrix(imp: DataFrame, model: str = "model") -> DataFrame:
    """K9: model x metric matrix of improvements (long -> pivot on a fixed metric list)."""
    long = imp.unpivot([model], [f"{m}_improvement" for m in METRICS], "metric", "value")
    long = long.withColumn("metric", F.upper(F.regexp_replace("metric", "_improvement", "")))
    return long.groupBy(model).pivot("metric", [m.upper() for m in METRICS]).agg(F.first("value"))


def radar_ratios(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Enhanced / baseline per metric; inverted (baseline / enhanced) for R2."""
    j = _paired_metrics(metrics, model)
    ratio = {m: F.try_divide(F.col(f"e_{m}"), F.col(f"b_{m}")) for m in ("rmse", "mae", "mape")}
    ratio["r2"] = F.try_divide(F.col("b_r2"), F.col("e_r2"))
    return j.select(model, *[clean_double(ratio[m]).alias(f"{m}_ratio") for m in METRICS])


# The Lanczos coefficients of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """Natural logarithm of the gamma function, for z of 0.5 or more."""
    x = z - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + float(i))
    t = x + 7.5
    return F.lit(0.9189385332046727) + (x + 0.5) * F.log(t) - t + F.log(series)


def half_step(a: Column) -> Column:
    """log_gamma(a + 1/2) - log_gamma(a), by its series in 1/a where the difference would
    lose digits."""
    series = (F.log(a) / 2 - 1.0 / (8.0 * a) + 1.0 / (192.0 * F.pow(a, F.lit(3.0))) - 1.0 / (640.0 * F.pow(a, F.lit(5.0)))
              + 17.0 / (14336.0 * F.pow(a, F.lit(7.0))))
    return F.when(a >= 50.0, series).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def beta_tail(x: Column, y: Column, log_x: Column, log_y: Column, a: Column, b: Column, log_beta: Column,
              terms: int = 300) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 0.5 by its continued
    fraction, evaluated from the front (modified Lentz) as a fold over a sequence; on the
    side of the mean where it converges slowly it is one minus the mirrored value. The
    complement y = 1 - x, the logarithms of both and of the beta function come from the
    caller, who can give them without loss of digits."""
    tiny = F.lit(1e-300)

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        d0 = F.lit(1.0) / safe(F.lit(1.0) - (a + b) * x / (a + 1.0))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(acc: Column, m: Column) -> Column:
            def advance(state, numerator):
                d = F.lit(1.0) / safe(F.lit(1.0) + numerator * state["d"])
                c = safe(F.lit(1.0) + numerator / state["c"])
                return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

            k = m.cast("double")
            even = k * (b - k) * x / ((a + 2.0 * k - 1.0) * (a + 2.0 * k))
            odd = -(a + k) * (a + b + k) * x / ((a + 2.0 * k) * (a + 2.0 * k + 1.0))
            # a one-element array holds the first half step, so that it is computed once
            half = F.transform(F.array(acc), lambda s: advance(s, even))
            return F.get(F.transform(half, lambda s: advance(s, odd)), F.lit(0))

        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["h"]

    front = F.exp(a * log_x + b * log_y - log_beta)
    low = x < (a + 1.0) / (a + b + 2.0)
    # one fold: the arguments are chosen before it
    u, p, q = (F.when(low, i).otherwise(j) for i, j in ((x, y), (a, b), (b, a)))
    value = front * fraction(u, p, q) / p
    inside = F.when(low, value).otherwise(F.lit(1.0) - value)
    return F.when(x <= 0.0, F.lit(0.0)).when(y <= 0.0, F.lit(1.0)).otherwise(inside)


def t_test_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t: the tails beyond +-t, I_x(dof/2, 1/2) at
    x = dof / (dof + t*t). NULL without a t or a degree of freedom."""
    n, square = dof.cast("double"), t * t
    x, y = n / (n + square), square / (n + square)
    log_beta = F.lit(0.5723649429247001) - half_step(n / 2.0)  # half the logarithm of pi
    tail = beta_tail(x, y, -F.log1p(square / n), F.log(y), n / 2.0, F.lit(0.5), log_beta)
    return F.when(t.isNotNull() & (n >= 1), tail)


def paired_error_test(paired: DataFrame, model: str = "model") -> DataFrame:
    """Paired t statistic on d = |base error| - |enhanced error| per model
    (positive: the enhanced forecast is closer); degrees of freedom n - 1 and the two-sided
    p-value of the statistic, NULL where all differences are equal."""
    d = F.abs(F.col("y_base") - F.col("y_true")) - F.abs(F.col("y_enh") - F.col("y_true"))
    g = paired.groupBy(model).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
                                  F.stddev_samp(d).alias("sd_diff"))
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n").cast("double")))
    tested = g.select(model, "n", "mean_diff", "sd_diff", clean_double(t).alias("t_stat"), (F.col("n") - 1).alias("dof"))
    return tested.withColumn("p_value", t_test_p(F.col("t_stat"), F.col("dof")))


def best_epoch(history: DataFrame, patience: int = 30, min_delta: float = 1e-5, monitor: str = "val_loss",
               keys: Sequence[str] = ("model", "variant")) -> DataFrame:
    """Early stopping replay per run: an epoch improves when the monitored value
    is below the last best minus ``min_delta``; training stops once ``patience``
    epochs pass without improvement. Returns best epoch/value and the stop epoch
    (the last epoch if it never stopped).

    A run's history is bounded by its epoch budget, so each run is scanned as one
    sorted array with ``aggregate``."""
    keys = list(keys)
    runs = history.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("e"),
                                             F.col(monitor).cast("double").alias("v")))).alias("_fc_h"))
    init = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
                    F.lit(0).cast("long").alias("wait"), F.lit(None).cast("long").alias("stop"))

    def step(acc, r):
        stopped = acc["stop"].isNotNull()
        improved = r["v"] < acc["best"] - F.lit(min_delta)
        wait = F.when(improved, F.lit(0).cast("long")).otherwise(acc["wait"] + 1)
        return F.when(stopped, acc).otherwise(F.struct(
            F.when(improved, r["v"]).otherwise(acc["best"]).alias("best"),
            F.when(improved, r["e"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            F.when(wait >= patience, r["e"]).alias("stop")))

    res = runs.select(*keys, F.aggregate("_fc_h", init, step).alias("_fc_r"),
                      F.element_at("_fc_h", -1)["e"].alias("_fc_last"))
    return res.select(*keys, F.col("_fc_r.best_epoch").alias("best_epoch"),
                      F.col("_fc_r.best").alias("best_value"),
                      F.coalesce(F.col("_fc_r.stop"), F.col("_fc_last")).alias("stop_epoch"),
                      F.col("_fc_r.stop").isNotNull().alias("stopped"))


def history_long(history: DataFrame, keys: Sequence[str] = ("model", "variant")) -> DataFrame:
    """(model, variant, epoch, metric, split, value) with split train/val."""
    keys = list(keys)
    metrics = ["loss", "mae", "mape", "mse", "r2"]
    cols = metrics + [f"val_{m}" for m in metrics]
    long = history.unpivot([*keys, "epoch"], cols, "_fc_name", "value")
    return long.select(*keys, "epoch",
                       F.regexp_replace("_fc_name", "^val_", "").alias("metric"),
                       F.when(F.col("_fc_name").startswith("val_"), "val").otherwise("train").alias("split"),
                       "value")


def prediction_series(paired: DataFrame, n: int, model: str = "model", ts: str = "ts") -> DataFrame:
    """The first ``n`` aligned (truth, baseline, enhanced) rows of each model in
    time order; positions come from the distributed row index, not a per-model
    single-task window."""
    idx = ordered.with_row_index(paired, [ts], [model], "_fc_pos")
    return idx.where(F.col("_fc_pos") < n).drop("_fc_pos")
