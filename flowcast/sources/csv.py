"""CSV sources and sinks.

Schemas are declared, never inferred: the first column is the timestamp, the
rest are doubles, found by the header of the file that a line comes from. pandas
writes NaN as an empty field; literal NaN/Inf text is also turned into NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast.functions.columns import clean_double
from flowcast.operators import ordered
from flowcast.session import cut_lineage

HISTORY_METRICS = ("loss", "val_loss", "mae", "val_mae", "mape", "val_mape",
                   "mse", "val_mse", "r2", "val_r2", "lr")


def file_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, names): the header of every CSV file at ``path``, one row a file, found by a
    scan of the lines with map-side combining; quoted names may hold commas. Files without
    a line have no row. The first name is that of the time column and may be empty."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line")) \
        .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    # a comma in front, so that every name, empty or not, is one match
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("head", "^\ufeff", "")),
                                 F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(cells, lambda c: F.trim(F.when(c.startswith('"'), F.replace(
        F.regexp_extract(c, '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(c)))
    return first.select("file", plain.alias("names"))


def _wanted(headers: DataFrame, columns: Sequence[str] | None, path) -> list[str]:
    """The value columns: those asked for, or the names of all headers in the order in which
    files (by path) bring them. A wide frame has as many columns, so they are fetched."""
    names = headers.select("file", F.posexplode("names").alias("at", "name")).where("at > 0")
    twice = names.groupBy("file", "name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"column {twice[0]['name']!r} is twice in the header of {twice[0]['file']}")
    limit = int(headers.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    seen = names.groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).limit(limit + 1).collect()
    if columns is not None:
        missing = sorted(set(columns) - {r["name"] for r in seen})
        if missing:
            raise ValueError(f"columns {missing} are in no header of {path}")
        return list(columns)
    if len(seen) > limit:
        raise ValueError(f"more than {limit} columns at {path}: name the columns to read")
    return [r["name"] for r in sorted(seen, key=lambda r: tuple(r["first"]))]


def _cells(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """(file, ts text, cells ARRAY<STRING>) with the cells in the order of the wanted
    columns, whatever the order in the file, and those columns' names."""
    headers = cut_lineage(file_headers(spark, path))
    names = _wanted(headers, columns, path)
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(width)])
    # by position; the reader skips each file's own header line
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    if not names:
        return raw.select(F.col("_metadata.file_path").alias("file"), F.col("c0").alias("ts"),
                          F.array().cast("array<string>").alias("cells")), names
    wanted = F.array(*[F.lit(n) for n in names])
    places = headers.select(F.col("file").alias("of_file"), F.transform(
        wanted, lambda n: F.array_position("names", n).cast("int") - 1).alias("places"))
    row = F.array(*[F.col(f"c{i}") for i in range(width)])
    joined = raw.select(F.col("_metadata.file_path").alias("file"), F.col("c0").alias("ts"), row.alias("row")) \
        .join(places, F.col("file") == F.col("of_file"))
    # a file without a column gives NULL there (place -1)
    return joined.select("file", "ts", F.transform("places", lambda p: F.when(
        p > 0, F.get("row", p))).alias("cells")), names


_NO_VALUE = "(?i)^\\s*([+-]?(nan|inf|infinity)|na|n/a|null|none)?\\s*$"  # missing, not wrong


def _is_bad(cell: Column) -> Column:
    return cell.isNotNull() & ~cell.rlike(_NO_VALUE) & cell.try_cast("double").isNull()


def _read_wide(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None,
               audit: Observation | None) -> DataFrame:
    """Files may list their columns in any order and need not all have every column. A cell
    that is no number, or a time that does not parse, is NULL; ``audit`` gets the counts
    n_rows, n_bad_times and n_bad_cells of the next action, in the same pass."""
    cells, names = _cells(spark, path, columns)
    ts = F.try_to_timestamp("ts").cast("timestamp_ntz")
    if audit is not None:
        cells = cells.observe(
            audit, F.count(F.lit(1)).alias("n_rows"), F.count_if(ts.isNull()).alias("n_bad_times"),
            F.coalesce(F.sum(F.size(F.filter("cells", _is_bad))), F.lit(0)).alias("n_bad_cells"))
    return cells.select(ts.alias("ts"), *[clean_double(F.get("cells", F.lit(i)).try_cast("double")).alias(n)
                                          for i, n in enumerate(names)])


def read_traffic(spark: SparkSession, path: str | Sequence[str], sensors: Sequence[str] | None = None,
                 audit: Observation | None = None) -> DataFrame:
    """A1: wide traffic CSVs -> (ts, <sensor columns> DOUBLE). Values follow each file's own
    header, so files may differ in their columns and order; see :func:`file_headers`."""
    return _read_wide(spark, path, sensors, audit)


def read_weather(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                 audit: Observation | None = None) -> DataFrame:
    """A2: weather CSVs -> (ts, <weather columns> DOUBLE), read like A1."""
    return _read_wide(spark, path, columns, audit)


def bad_cells(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, n_missing, n_bad) for the wide CSVs at ``path``: cells that hold no
    value, and cells whose text is no number; the time column is listed as ``ts``."""
    cells, names = _cells(spark, path, columns)
    stamp = F.struct(F.lit("ts").alias("column"), F.col("ts").alias("cell"), (
        F.col("ts").isNotNull() & F.try_to_timestamp("ts").isNull()).alias("bad"))
    listed = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), F.col("cells").alias("c")),
                         lambda x: F.struct(x["n"].alias("column"), x["c"].alias("cell"), _is_bad(x["c"]).alias("bad")))
    every = F.concat(F.array(stamp), listed) if names else F.array(stamp)
    long = cells.select(F.inline(every))
    gone = F.col("cell").isNull() | (F.col("cell").rlike(_NO_VALUE) & (F.col("column") != "ts"))
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gone).alias("n_missing"),
                                      F.count_if("bad").alias("n_bad"))


def write_wide_csv(df: DataFrame, path: str) -> None:
    """Write a wide frame as CSV with a header (the layout A1/A2 read)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_history(df: DataFrame, path: str) -> None:
    """A4: one CSV per (model, variant) in ``<path>/run=<model>_<variant>_history``: the
    eleven metric columns, one line an epoch in order. A run's length is its number of
    epochs, so a run is written by one task and runs by many."""
    (df.select(F.concat_ws("_", "model", "variant", F.lit("history")).alias("run"), "epoch", *HISTORY_METRICS)
       .repartition("run").sortWithinPartitions("run", "epoch").drop("epoch")
       .write.mode("overwrite").option("header", True).partitionBy("run").csv(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All history CSVs below ``path`` united; model and variant come from the folder
    (``run=<model>_<variant>_history``) or file name, the epoch is the line's number in
    its file. Files whose header is not the eleven metric columns fail."""
    schema = T.StructType([T.StructField(m, T.DoubleType(), True) for m in HISTORY_METRICS])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    pattern = r"([^/=]+)_(baseline|enhanced)_history"
    lines = df.select(*HISTORY_METRICS, F.col("_metadata.file_path").alias("_fc_file"),
                      F.col("_metadata.file_block_start").alias("_fc_block"),
                      F.monotonically_increasing_id().alias("_fc_line"))
    numbered = ordered.with_row_index(lines, ["_fc_block", "_fc_line"], ["_fc_file"], "epoch")
    return numbered.select(
        F.regexp_extract("_fc_file", pattern, 1).alias("model"),
        F.regexp_extract("_fc_file", pattern, 2).alias("variant"),
        (F.col("epoch") + 1).alias("epoch"), *HISTORY_METRICS)


def write_summary(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A5: improvement summary sink (json or parquet), one row a model."""
    df.write.mode("overwrite").format(fmt).save(path)
