"""Scaling, chronological and random splits, augmentation (H1-H7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcast.functions.columns import with_scalars
from flowcast.operators import ordered
from flowcast.operators.ordered import RN

_TINY = 10 * 2.220446049250313e-16  # scales below this count as zero (then 1)


def _population(df: DataFrame, cols: Sequence[str], fit: DataFrame, of: str | None, change) -> DataFrame:
    """``change(value, mean, scale)`` for each of ``cols``, with the mean and population std
    of the like-named column of ``fit``, or of its column ``of`` for all."""
    cols = list(cols)
    names = cols if of is None else [of]
    j, s = with_scalars(df, fit.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(names)],
                                    *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(names)]),
                        "_fc_z")
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c) if of is None else 0
            sd = F.when(s[f"s{i}"] < _TINY, F.lit(1.0)).otherwise(s[f"s{i}"])
            out.append(change(F.col(f"`{c}`"), s[f"m{i}"], sd).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return j.select(*out)


def zscore_population(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                      of: str | None = None) -> DataFrame:
    """H1: (x - mean) / population std, statistics from ``fit`` (default: all rows);
    a zero std divides by 1, so a constant column becomes 0."""
    return _population(df, cols, fit if fit is not None else df, of, lambda x, mean, sd: (x - mean) / sd)


def zscore_population_array(df: DataFrame, col: str, fit: DataFrame | None = None) -> DataFrame:
    """H1 for an ARRAY<DOUBLE> column with one value a sensor (the array layout of A3): each
    position is scaled by its own mean and population std over ``fit``. The statistics are
    one row a position and travel as one array, no longer than a row's own."""
    src = fit if fit is not None else df
    per = src.select(F.posexplode(col).alias("pos", "_fc_v")).groupBy("pos").agg(
        F.avg("_fc_v").alias("m"), F.stddev_pop("_fc_v").alias("s"))
    stats = per.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("z"))
    j, s = with_scalars(df, stats, "_fc_za")
    scaled = F.zip_with(F.col(col), s["z"], lambda x, z: (x - z["m"]) / F.when(z["s"] < _TINY, F.lit(1.0)).otherwise(z["s"]))
    return j.select(*[scaled.alias(c) if c == col else F.col(f"`{c}`") for c in df.columns])


def unscale_population(df: DataFrame, cols: Sequence[str], fit: DataFrame, of: str | None = None) -> DataFrame:
    """The inverse of :func:`zscore_population` fitted on ``fit``: x * std + mean, so
    labels and forecasts come back in original units."""
    return _population(df, cols, fit, of, lambda x, mean, sd: x * sd + mean)


def zscore_sample(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                  on_constant: str = "error") -> DataFrame:
    """H2: (x - mean) / sample std (ddof=1).

    A constant column has no defined z-score (the reference gets NaN there and a
    later NULL drop then removes every row). ``on_constant``: ``"error"`` (default)
    fails the query with a clear message, ``"null"`` returns NULL, ``"zero"``
    returns 0 (the column carries no information, the rows are kept)."""
    cols = list(cols)
    src = fit if fit is not None else df
    j, s = with_scalars(df, src.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)],
                                    *[F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)]),
                        "_fc_z")
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            z = F.when(s[f"s{i}"] > 0, (F.col(f"`{c}`") - s[f"m{i}"]) / s[f"s{i}"])
            if on_constant == "error":
                z = F.when(s[f"s{i}"] == 0, F.raise_error(F.lit(f"zscore_sample: column {c} is constant"))
                           .cast("double")).otherwise(z)
            elif on_constant == "zero":
                z = F.when(s[f"s{i}"] == 0, F.lit(0.0)).otherwise(z)
            out.append(z.alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return j.select(*out)


def split_sizes(n: int, train: float = 0.7, val: float = 0.15) -> tuple[int, int, int]:
    """Sizes of the chronological split: int(n*train), int(n*val), the rest."""
    a, b = int(n * train), int(n * val)
    return a, b, n - a - b


def chronological_split(df: DataFrame, train: float = 0.7, val: float = 0.15, order_by=("ts",), series=(),
                        index_col: str = RN) -> DataFrame:
    """H3: label rows train/val/test by position: the first floor(n*train) rows,
    the next floor(n*val), then the rest (double products, as in the reference)."""
    if index_col in df.columns:
        indexed, s = with_scalars(df, df.agg(F.count(F.lit(1)).alias("n")), "_fc_cnt")
        n = s["n"]
    else:
        indexed = ordered.with_row_index(df, order_by, series, index_col, count_col="_fc_n")
        n = F.col("_fc_n")
    a = F.floor(n.cast("double") * F.lit(float(train)))
    b = F.floor(n.cast("double") * F.lit(float(val)))
    rn = F.col(index_col)
    out = indexed.withColumn("split", F.when(rn < a, "train").when(rn < a + b, "val").otherwise("test"))
    return out.drop("_fc_n", "_fc_cnt")


def random_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """H4: exact-size shuffled split: ceil(n*(1-train)) rows are held out and
    ceil(held*test/(val+test)) of them go to test (double arithmetic, so n=10 holds
    out 4 rows). Rows are chosen by the rank of md5(key:seed), so the split is
    reproducible and needs no single-task sort."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashed = df.withColumn("_fc_h", h).withColumn("_fc_hn", F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))
    indexed = ordered.with_row_index(hashed, ["_fc_hn", "_fc_h", key], (), "_fc_r",
                                     count_col="_fc_n")
    n = F.col("_fc_n").cast("double")
    held = F.ceil(n * F.lit(1.0 - train))
    n_test = F.ceil(held * F.lit(test / (val + test)))
    r = F.col("_fc_r")
    return (indexed.withColumn("split", F.when(r < n_test, "test").when(r < held, "val").otherwise("train"))
                   .drop("_fc_h", "_fc_hn", "_fc_r", "_fc_n"))


def hash_uniform(key, tag: str):
    """A number in (0, 1) from md5(key:tag): the same for a row wherever and however often
    it is computed."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{tag}")))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def augment_noise(df: DataFrame, cols: Sequence[str], key, sigma: float = 0.01, seed: int = 42) -> DataFrame:
    """H5: add N(0, sigma) noise to each value (Box-Muller on two hash numbers of the row's
    ``key`` column, the column name and the seed)."""
    def noise(c):
        u, v = hash_uniform(key, f"{c}:{seed}:u"), hash_uniform(key, f"{c}:{seed}:v")
        return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * v) * sigma
    return df.select(*[(F.col(c) + noise(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def augment_scale(df: DataFrame, cols: Sequence[str], key, low: float = 0.95, high: float = 1.05,
                  seed: int = 43) -> DataFrame:
    """H6: multiply each value by U(low, high), the number being a hash as in H5."""
    return df.select(*[(F.col(c) * (F.lit(low) + hash_uniform(key, f"{c}:{seed}:s") * (high - low))).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def augment(df: DataFrame, cols: Sequence[str], key, seed: int = 42) -> DataFrame:
    """H7: original + noisy + scaled copies (3n rows, labels kept), tagged by ``copy``.
    ``key`` is a column expression that tells rows apart."""
    return (df.withColumn("copy", F.lit("original"))
              .unionByName(augment_noise(df, cols, key, seed=seed).withColumn("copy", F.lit("noise")))
              .unionByName(augment_scale(df, cols, key, seed=seed + 1).withColumn("copy", F.lit("scale"))))
