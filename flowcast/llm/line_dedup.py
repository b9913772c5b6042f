"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines that hold a word (blank lines are skipped
over and never removed) is a window. A window's content is compared through two
independent 64-bit hashes of its lines. Of all occurrences of a content in the
corpus the first, by (document id, text hash, row, position), stays; every later
occurrence covers its three lines, and covered lines are removed. Overlapping
windows merge by collecting covered line numbers in a set.

Defined cases: a null text stays null and has no line; an empty text has one blank
line; a document with fewer than three lines with a word has no window and is left
alone; rows with equal id and text are one document stored twice and get the same
result, both rows staying; a null id sorts first, and each row without an id is a
document of its own; an empty table gives an empty table; other columns pass through untouched whatever their names.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import fresh, materialise, read

BLANK = r"[^\x20\x09-\x0D]"


def _numbered(docs: DataFrame, id_col: str, row_col: str) -> DataFrame:
    """``docs`` with a number in ``row_col`` that tells rows without an id apart, 0 elsewhere."""
    # written, so that the numbers stay when they are read again
    lost = materialise(docs.where(F.col(id_col).isNull()).withColumn(row_col, F.monotonically_increasing_id()),
                       "line-without-id")
    return docs.where(F.col(id_col).isNotNull()).withColumn(row_col, F.lit(0).cast("long")).unionByName(lost)


def _windows(docs: DataFrame, id_col: str, text_col: str, row_col: str, size: int) -> DataFrame:
    """(id, k, row, at, lines, h1, h2): one row per window; ``lines`` holds line numbers."""
    numbered = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1),
                    lambda line, i: F.when(line.rlike(BLANK), F.struct(
                        i.alias("i"), F.xxhash64(line).alias("a"),
                        F.xxhash64(F.lit("second"), line).alias("b")))),
        lambda x: x.isNotNull())
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("k"), F.col(row_col).alias("row"),
                       numbered.alias("ls"))
    base = base.where(F.size("ls") >= size)

    def window(at: Column) -> Column:
        part = [F.get(F.col("ls"), at + j) for j in range(size)]
        return F.struct(at.alias("at"), F.array(*[p["i"] for p in part]).alias("lines"),
                        F.xxhash64(*[p["a"] for p in part]).alias("h1"),
                        F.xxhash64(*[p["b"] for p in part]).alias("h2"))

    return base.select("id", "k", "row", F.inline(F.transform(F.sequence(F.lit(0), F.size("ls") - size), window)))


def repeated_lines(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = 3) -> DataFrame:
    """(id, k, row, gone): the distinct line numbers to remove, for documents that have any.
    ``k`` is xxhash64 of the text, ``row`` is ``row_col`` of :func:`_numbered`."""
    docs = docs.select(F.col(id_col), F.col(text_col), F.col(row_col)).where(F.col(text_col).isNotNull())
    windows = materialise(_windows(docs, id_col, text_col, row_col, size), "line-windows")
    first = (windows.groupBy("h1", "h2")
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k", "row", "at")).alias("first"))
             .where("n > 1").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"))
    # written, so that the join shuffles both sides by itself and AQE can split the rows of
    # a window that very many documents share
    first = materialise(first, "line-first")
    later = (windows.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
             .where(~F.struct("id", "k", "row", "at").eqNullSafe(F.col("first"))))
    return (later.select("id", "k", "row", F.explode("lines").alias("line"))
            .groupBy("id", "k", "row").agg(F.collect_set("line").alias("gone")))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                          lines_col: str | None = None, removed_col: str | None = None) -> DataFrame:
    """``docs`` with the covered lines taken out of the text; with ``lines_col`` and
    ``removed_col`` also the number of lines and of removed lines (long)."""
    gid, gk, grow, gone, k, row = fresh(docs, "dedup_id", "dedup_k", "dedup_gone_row", "dedup_gone", "dedup_key", "dedup_row")
    numbered = _numbered(docs, id_col, row)
    cover = repeated_lines(numbered, row, id_col, text_col, size).toDF(gid, gk, grow, gone)
    keyed = numbered.withColumn(k, F.xxhash64(F.col(text_col)))
    joined = keyed.join(cover, F.col(id_col).eqNullSafe(F.col(gid)) & (F.col(k) == F.col(gk))
                        & (F.col(row) == F.col(grow)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # array_except on integers hashes, so that long documents stay linear
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = [kept.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    if lines_col:
        out.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(lines_col))
    if removed_col:
        out.append(F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(removed_col))
    return joined.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = remove_repeated_lines(docs, lines_col="n_lines", removed_col="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE text IS NOT NULL) q
), p AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT a.doc_id, a.n AS pos, a.i AS i0, b.i AS i1, c.i AS i2,
         a.line || chr(10) || b.line || chr(10) || c.line AS content
  FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.n = a.n + 1
           JOIN p c ON c.doc_id = a.doc_id AND c.n = a.n + 2
), r AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS nth FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM r WHERE nth > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS t
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(t) END AS kept_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
