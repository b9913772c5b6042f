"""Baseline-versus-weather-enhanced forecast experiment on distributed regressors
(J1-J9, K15).

The reference trains recurrent/convolutional networks on one machine; here each
model family is a ``pyspark.ml`` estimator trained on the flattened sequence
vector (``length x features`` values), so fitting, scoring and importance all
run as Spark jobs over partitions:

* ``linear``  -> ``LinearRegression`` (elastic net, standardised features)
* ``forest``  -> ``RandomForestRegressor``
* ``boosted`` -> ``GBTRegressor``, cut back to its best iteration on the validation rows by
  the stopping rule of K12 (J5)

Predictions are joined to labels by timestamp (not by position), and the
enhanced variant is scored against its own labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcast.functions.columns import with_scalars
from flowcast.operators import evaluate as K
from flowcast.operators import ordered
from flowcast.operators.scale import unscale_population
from flowcast.operators.timeseries import sequence_vector
from flowcast.plans.prepare import prepare_dataset
from flowcast.session import cut_lineage

MODELS = ("linear", "forest", "boosted")
VARIANTS = ("baseline", "enhanced")
SEED = 42


# Windows that one task of a fit handles: each of the many jobs of a fit passes over them.
TASK_ROWS = 4096

# Fixed values of the stopping rule: epochs without improvement, and what counts as one.
PATIENCE, MIN_DELTA = 30, 1e-5


def estimator(name: str, seed: int = SEED, trees: int = 20, forest_depth: int = 5, rounds: int = 40,
              boosted_depth: int = 3, reg: float = 0.01):
    """J1/J2 model families; the defaults are small, the sizes are parameters."""
    if name == "linear":
        return LinearRegression(featuresCol="features", labelCol="y", maxIter=50, regParam=reg,
                                elasticNetParam=0.0, standardization=True)
    if name == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=forest_depth, seed=seed,
                                     subsamplingRate=0.8)
    if name == "boosted":
        return GBTRegressor(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=boosted_depth, stepSize=0.1, seed=seed)
    raise ValueError(f"unknown model {name!r}")


def vectorised(dataset: DataFrame) -> DataFrame:
    """Sequences -> (seq_idx, ts, y, split, features, x) with the window flattened."""
    return sequence_vector(dataset).select("seq_idx", "ts", "y", "split", "features", "x")


def fit(name: str, data: DataFrame, seed: int = SEED, patience: int = PATIENCE, min_delta: float = MIN_DELTA, **sizes):
    """Fit one model family on the training rows. The boosted model runs all its
    rounds and is then cut to the iteration that the stopping rule would restore (J5).
    Without training rows there is no model: None."""
    train = data.where(F.col("split") == "train")
    if train.isEmpty():
        return None
    model = estimator(name, seed, **sizes).fit(train)
    if name != "boosted":
        return model
    return cut_ensemble(model, best_iteration(iteration_metrics(model, data.where(F.col("split") == "val")), patience, min_delta))


def best_iteration(curve: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA) -> int | None:
    """The iteration of J6's curve (iteration, split, loss) with the best validation loss
    before ``patience`` iterations brought no improvement of ``min_delta``, as K12 replays it:
    a later dip within the patience wins over an earlier one. None without validation rows.
    The curve has one row an iteration, a parameter of the fit."""
    history = curve.where(F.col("split") == "val").select(F.lit(0).alias("run"), F.col("iteration").alias("epoch"), "loss")
    found = K.best_epoch(history, patience, min_delta, "loss", ["run"]).first()
    return None if found is None or found["best_epoch"] is None else int(found["best_epoch"])


def cut_ensemble(model: GBTRegressionModel, iterations: int | None) -> GBTRegressionModel:
    """The boosted model of its first ``iterations`` trees (all, if None)."""
    if iterations is None or iterations >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkContext.getOrCreate()._gateway
    package = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(package.DecisionTreeRegressionModel, iterations)
    weights = gateway.new_array(gateway.jvm.double, iterations)
    for i in range(iterations):
        trees[i], weights[i] = java.trees()[i], float(model.treeWeights[i])
    short = package.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    return GBTRegressionModel(java.copyValues(short, java.extractParamMap()))


PREDICTIONS = "ts timestamp_ntz, model string, variant string, y_true double, y_pred double"


def predict(model, data: DataFrame, name: str, variant: str) -> DataFrame:
    """Batch scoring of the test rows -> (ts, model, variant, y_true, y_pred); no row
    where there is no model."""
    if model is None:
        return data.sparkSession.createDataFrame([], PREDICTIONS)
    scored = model.transform(data.where(F.col("split") == "test"))
    return scored.select("ts", F.lit(name).alias("model"), F.lit(variant).alias("variant"),
                         F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))


def prepare_variants(readings: DataFrame, weather: DataFrame, width: str, sensors: Sequence[str], length: int = 24,
                     on_constant: str = "error", **kw) -> dict[str, DataFrame]:
    """Both prepared datasets, vectorised. The feature table under each is already
    checkpointed; the sequence tensor itself (``length`` times the feature table) is
    not materialised here -- the estimators persist their own training instances. More than
    ``TASK_ROWS`` windows are spread over tasks, in an order that reruns repeat."""
    out = {}
    for variant, w in (("baseline", None), ("enhanced", weather)):
        ds = prepare_dataset(readings, w, length=length, width=width, sensors=sensors, on_constant=on_constant,
                             **{"task_rows": TASK_ROWS} | kw)
        out[variant] = vectorised(ds)
    return out


def run_experiment(readings: DataFrame, weather: DataFrame, width: str, sensors: Sequence[str], length: int = 24,
                   models: Sequence[str] = MODELS, on_constant: str = "error", seed: int = SEED, **kw):
    """Fit every model family on both variants; return (predictions, fitted
    models, prepared data). Metrics and improvements follow from K1/K5 on the
    predictions."""
    data = prepare_variants(readings, weather, width, sensors, length, on_constant, **kw)
    fitted, preds = {}, []
    for variant in VARIANTS:
        for name in models:
            m = fit(name, data[variant], seed)
            fitted[(name, variant)] = m
            preds.append(predict(m, data[variant], name, variant))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out, fitted, data


def original_units(preds: DataFrame, features: dict[str, DataFrame], target_col: str = "speed_ma30") -> DataFrame:
    """Labels and forecasts of each variant in the units of ``target_col``: ``features``
    maps a variant to the unscaled feature table its scaler was fitted on. Predictions of
    other variants are left out."""
    parts = [unscale_population(preds.where(F.col("variant") == v), ["y_true", "y_pred"], fit, of=target_col)
             for v, fit in features.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ITERATIONS = "iteration int, split string, loss double, rmse double, mae double, mape double, r2 double"


def iteration_metrics(gbt_model, data: DataFrame) -> DataFrame:
    """Loss (mean squared error), RMSE, MAE, MAPE and R2 after each boosting iteration,
    on train and validation rows. Each tree scores every row once; the prediction after
    iteration i is the running sum of weighted trees, so one pass gives all iterations."""
    if gbt_model is None:
        return data.sparkSession.createDataFrame([], ITERATIONS)
    part = data.where(F.col("split").isin("train", "val")).select("split", "y", "features")
    running = []
    for j, (tree, weight) in enumerate(zip(gbt_model.trees, gbt_model.treeWeights)):
        part = tree.setFeaturesCol("features").setPredictionCol(f"_fc_t{j}").transform(part)
        term = F.col(f"_fc_t{j}") * F.lit(float(weight))
        running.append(term if j == 0 else F.col(f"_fc_c{j - 1}") + term)
        part = part.withColumn(f"_fc_c{j}", running[-1]).drop(f"_fc_t{j}")
    steps = F.posexplode(F.array(*[F.col(f"_fc_c{j}") for j in range(len(running))])).alias("_fc_i", "y_pred")
    long = part.select("split", F.col("y").alias("y_true"), steps).withColumn("iteration", F.col("_fc_i") + 1)
    long = long.withColumn("_fc_e2", (F.col("y_pred") - F.col("y_true")) * (F.col("y_pred") - F.col("y_true")))
    m = K.regression_metrics(long, ["iteration", "split"])
    loss = long.groupBy(F.col("iteration").alias("_fc_it"), F.col("split").alias("_fc_sp")).agg(F.avg("_fc_e2").alias("loss"))
    return m.join(loss, (F.col("iteration") == F.col("_fc_it")) & (F.col("split") == F.col("_fc_sp"))).select(
        "iteration", "split", "loss", "rmse", "mae", "mape", "r2")


def permutations(data: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(seq_idx, repeat, donor): one permutation of the rows a repeat, all in one pass. The
    row at position i takes the window of the row whose hash ranks i-th; ranks come from the
    distributed row index, one series a repeat."""
    key = F.md5(F.concat_ws(":", F.col("seq_idx").cast("string"), F.lit(str(seed)), F.col("repeat").cast("string")))
    every = data.select(F.col("seq_idx").alias("donor"), F.col("seq_idx"), F.explode(
        F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    ranked = ordered.with_row_index(every.select("donor", "repeat", key.alias("_fc_h")), ["_fc_h", "donor"], ["repeat"], "_fc_pos")
    place = ordered.with_row_index(data.select("seq_idx"), ["seq_idx"], (), "_fc_pos")
    return ranked.join(place, "_fc_pos").select("seq_idx", "repeat", "donor")


IMPORTANCE = "feature string, importance double, importance_std double"


def permutation_importance(model, data: DataFrame, feature_names: Sequence[str], repeats: int = 10,
                           seed: int = SEED, split: str = "test", score: str = "r2", method: str | None = None) -> DataFrame:
    """J7 (``score='r2'``): mean drop in R2 when one feature's whole sequence is
    taken from another row (one permutation per repeat, shared by all features).
    J8 (``score='perturbation'``): mean squared change of the prediction instead.

    A linear model is rescored by feature block (``method='block'``): what a feature's window
    adds to a prediction is one number, so a row is nf numbers instead of its whole window,
    and a swap changes the prediction by the donor's number less its own; nothing is copied a
    feature. Other models score every (repeat, feature) variant in one transform
    (``'swap'``): each row is copied once per variant with that feature's windows swapped."""
    names = list(feature_names)
    if model is None:
        return data.sparkSession.createDataFrame([], IMPORTANCE)
    method = method or ("block" if isinstance(model, LinearRegressionModel) else "swap")
    base = data.where(F.col("split") == split).select("seq_idx", "y", "x", "features")
    changed = (_block_changes if method == "block" else _swap_changes)(model, base, names, repeats, seed)
    sums = changed.groupBy("feature", "repeat").agg(
        F.sum((F.col("y") - F.col("p0") - F.col("d")) * (F.col("y") - F.col("p0") - F.col("d"))).alias("sse1"),
        F.sum((F.col("y") - F.col("p0")) * (F.col("y") - F.col("p0"))).alias("sse0"),
        F.var_pop("y").alias("var"), F.count(F.lit(1)).alias("n"), F.avg(F.col("d") * F.col("d")).alias("moved"))
    # R2 before less R2 after; a label that does not vary has no R2 to lose
    v = F.col("moved") if score != "r2" else F.try_divide(F.col("sse1") - F.col("sse0"), F.col("var") * F.col("n"))
    return sums.select("feature", v.alias("v")).groupBy("feature").agg(
        F.avg("v").alias("importance"), F.stddev_samp("v").alias("importance_std"))


def _block_changes(model: LinearRegressionModel, base: DataFrame, names: list[str], repeats: int, seed: int) -> DataFrame:
    """(y, p0, feature, repeat, d): the change of a linear prediction by each swap."""
    weights = [float(w) for w in model.coefficients]
    length = len(weights) // len(names)

    def part(j: int):
        """A feature's part of the prediction: its weights over the window times its values."""
        over_time = F.array(*[F.lit(weights[t * len(names) + j]) for t in range(length)])
        return F.aggregate(F.zip_with("x", over_time, lambda row, w: F.get(row, F.lit(j)) * w), F.lit(0.0), lambda acc, v: acc + v)

    parts = F.array(*[part(j) for j in range(len(names))])
    total = F.aggregate("c", F.lit(float(model.intercept)), lambda acc, v: acc + v)
    rows = cut_lineage(base.select("seq_idx", "y", parts.alias("c")).withColumn("p0", total))
    donors = rows.select(F.col("seq_idx").alias("donor"), F.col("c").alias("other"))
    moved = permutations(rows, repeats, seed).join(rows, "seq_idx").join(donors, "donor")
    each = F.inline(F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), "c", "other"),
                                lambda z: F.struct(z["n"].alias("feature"), (z["other"] - z["c"]).alias("d"))))
    return moved.select("y", "p0", "repeat", each)


def _swap_changes(model, base: DataFrame, names: list[str], repeats: int, seed: int) -> DataFrame:
    """The same for any model, by scoring every row with each feature's window swapped."""
    from pyspark.ml.functions import array_to_vector
    # the scored split is read by every repeat: materialise just its windows once
    base = cut_lineage(base)
    nf = len(names)
    ref = model.transform(base).select("seq_idx", "y", F.col("prediction").alias("p0"))
    donors = base.select(F.col("seq_idx").alias("donor"), F.col("x").alias("x_perm"))

    def swap(j: int):
        # time step by time step: features before j from x, feature j from x_perm, the rest from x
        return F.zip_with("x", "x_perm", lambda u, v: F.concat(
            F.slice(u, 1, j), F.slice(v, j + 1, 1), F.slice(u, j + 2, nf - j - 1)))

    variants = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), swap(j).alias("xs")) for j, n in enumerate(names)]))
    copies = permutations(base, repeats, seed).join(base.select("seq_idx", "x"), "seq_idx").join(donors, "donor")
    swapped = copies.select("seq_idx", "repeat", variants).withColumn("features", array_to_vector(F.flatten("xs")))
    scored = model.transform(swapped).select("seq_idx", "repeat", "feature", F.col("prediction").alias("p1"))
    return scored.join(ref, "seq_idx").select("y", "p0", "feature", "repeat", (F.col("p1") - F.col("p0")).alias("d"))


def weight_importance(model, feature_names: Sequence[str], length: int, name: str) -> DataFrame:
    """Per base feature, mean |coefficient| over the window positions (linear,
    on standardised inputs) or mean tree importance (forest/boosted); names follow
    the vector layout (time step major, feature minor)."""
    import numpy as np

    from pyspark.sql import SparkSession
    nf = len(feature_names)
    if model is None:
        return SparkSession.getActiveSession().createDataFrame([], "feature string, importance double")
    if name == "linear":
        w = np.abs(np.asarray(model.coefficients.toArray()))
    else:
        w = np.asarray(model.featureImportances.toArray())
    per = w.reshape(length, nf).mean(axis=0)
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feature_names, per)],
                                 "feature string, importance double")


def weather_impact_summary(metrics: DataFrame, by_condition: DataFrame, importance: DataFrame,
                           weather_features: Sequence[str]) -> DataFrame:
    """Overall improvement per model, enhanced-vs-baseline RMSE ratio per
    condition, and the summed importance of the weather features."""
    imp = K.improvements(metrics)
    cond = (by_condition.groupBy("model", "condition")
                        .agg(F.first(F.when(F.col("variant") == "baseline", F.col("rmse")), True).alias("b"),
                             F.first(F.when(F.col("variant") == "enhanced", F.col("rmse")), True).alias("e"))
                        .select("model", "condition", F.try_divide(F.col("e"), F.col("b")).alias("rmse_ratio")))
    cond_w = cond.groupBy("model").pivot("condition", ["overall", "normal", "extreme", "rush_hour"]).agg(
        F.first("rmse_ratio"))
    w_imp = importance.where(F.col("feature").isin(list(weather_features))).agg(
        F.sum("importance").alias("weather_importance"))
    out, s = with_scalars(imp.join(cond_w, "model", "left"), w_imp, "_fc_w")
    return out.withColumn("weather_importance", s["weather_importance"]).drop("_fc_w")
