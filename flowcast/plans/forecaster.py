"""Forecasters that are fitted once, saved, and score new tables later.

``forecaster`` puts a scaler, the sequence windows and a regressor into one ``pyspark.ml``
pipeline. What is fitted (a mean and a scale a column, the regressor's own state) is saved
with the pipeline model, so new rows are scaled by the statistics of the rows it was fitted
on, not by their own:

    model = forecaster(["a", "b"], "b", length=24).fit(train_rows)
    model.write().save(path)
    scored = load_forecaster(path).transform(new_rows)       # (seq_idx, ts, y, ..., prediction)
    in_units = unscaled(model, scored, ["y", "prediction"])
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcast.operators.scale import _TINY
from flowcast.operators.timeseries import sequence_vector, sequences
from flowcast.plans.experiment import estimator


class _Columns(Params):
    cols = Param(Params._dummy(), "cols", "columns to scale, in place", TypeConverters.toListString)


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """H1 as an estimator: mean and population std of each column, by one aggregation (NULLs
    left out). A column without a value cannot be fitted and raises ValueError."""

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = ()):
        super().__init__()
        self._set(cols=list(cols))

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getOrDefault(self.cols)
        parts = [(F.avg(F.col(f"`{c}`").cast("double")), F.stddev_pop(F.col(f"`{c}`").cast("double"))) for c in cols]
        row = dataset.agg(F.array(*[m for m, _ in parts]).alias("m"), F.array(*[s for _, s in parts]).alias("s")).first()
        empty = [c for c, m in zip(cols, row["m"]) if m is None]
        if empty:
            raise ValueError(f"PopulationScaler: no value in {', '.join(empty)}")
        scales = [1.0 if s < _TINY else s for s in row["s"]]
        return PopulationScalerModel(cols=cols, means=row["m"], scales=scales)


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / scale with the fitted statistics; a column that did not vary is only
    centred. NULL stays NULL, other columns pass through."""

    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted scales", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), means: Sequence[float] = (), scales: Sequence[float] = ()):
        super().__init__()
        self._set(cols=list(cols), means=list(means), scales=list(scales))

    def statistics(self) -> dict[str, tuple[float, float]]:
        """Mean and scale of each column."""
        return dict(zip(self.getOrDefault(self.cols), zip(self.getOrDefault(self.means), self.getOrDefault(self.scales))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = self.statistics()
        return dataset.select(*[((F.col(f"`{c}`") - known[c][0]) / known[c][1]).alias(c) if c in known else F.col(f"`{c}`")
                                for c in dataset.columns])

    def inverse(self, dataset: DataFrame, cols: Sequence[str], of: str | None = None) -> DataFrame:
        """x * scale + mean for each of ``cols``, by its own statistics or by those of ``of``."""
        known = self.statistics()
        return dataset.withColumns({c: F.col(f"`{c}`") * known[of or c][1] + known[of or c][0] for c in cols})


class SequenceWindows(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """E5 as a transformer: (seq_idx, ts, y, x, features) for every row that has a whole
    window before it. Rows are ordered by the time column, which must be unique."""

    inputs = Param(Params._dummy(), "inputs", "columns of the window", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "column of the label", TypeConverters.toString)
    length = Param(Params._dummy(), "length", "rows of the window", TypeConverters.toInt)
    horizon = Param(Params._dummy(), "horizon", "rows from the window to the label", TypeConverters.toInt)
    time = Param(Params._dummy(), "time", "time column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputs: Sequence[str] = (), target: str = "target", length: int = 24, horizon: int = 1, time: str = "ts"):
        super().__init__()
        self._set(inputs=list(inputs), target=target, length=length, horizon=horizon, time=time)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return sequence_vector(sequences(dataset, get(self.inputs), get(self.target), get(self.length), get(self.horizon),
                                         [get(self.time)]))


def forecaster(inputs: Sequence[str], target: str, length: int = 24, horizon: int = 1, name: str = "linear",
               time: str = "ts", **sizes) -> Pipeline:
    """Unfitted pipeline: scaler of the inputs and the target, windows, and a regressor of
    family ``name`` (J1). Label and prediction are in scaled units (see :func:`unscaled`)."""
    cols = list(dict.fromkeys([*inputs, target]))
    return Pipeline(stages=[PopulationScaler(cols=cols),
                            SequenceWindows(inputs=list(inputs), target=target, length=length, horizon=horizon, time=time),
                            estimator(name, **sizes)])


def load_forecaster(path: str) -> PipelineModel:
    """A saved forecaster; raises ValueError for any other pipeline."""
    model = PipelineModel.load(path)
    kinds = [type(s) for s in model.stages[:2]]
    if kinds != [PopulationScalerModel, SequenceWindows]:
        raise ValueError(f"{path} holds no forecaster")
    return model


def unscaled(model: PipelineModel, scored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Labels or predictions in the units of the target."""
    scaler, windows = model.stages[:2]
    return scaler.inverse(scored, cols, of=windows.getOrDefault(windows.target))
