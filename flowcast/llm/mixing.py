"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
Tokens flow from patterns to the quotas of their sources; a pattern can be used up to
``max_repeats`` times, and each further use costs more (convex), so the cheapest flow
repeats as little as it can. Because only the edges into patterns cost anything, and
their costs rise with the level, the cheapest flow is found by a maximum flow at one
use, extended at two, and so on. Then documents are selected: a pattern's flow is a
number of whole uses and a rest, and the rest takes documents in the order of a seeded
hash until the nearest whole document.

A source that no document shares with another needs no flow: its quota is filled from its
one pattern by Spark, however many such sources there are. Only patterns that touch a
shared source (at most ``max_patterns``, checked) go to the flow on the driver. The
running sum over a pattern's documents goes through 65,536 hash buckets, summed in two
levels of 256, so no window holds more than 256 rows or one bucket's distinct (id, size)
pairs; equal rows are counted first, so one id may have any number of them.

Defined cases: a null text has size 0; a document of size 0 takes 0; null is a source
of its own, ordered last; an empty set of sources gets nothing; repeated rows each count
and take alike; when nothing has any size all targets are 0; an empty table gives an
empty table; other columns never take part, whatever their names. More than ``max_patterns``
patterns that share sources raise ValueError. Texts are counted whole.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowcast.functions.columns import with_scalars
from flowcast.llm.common import WORD_SQL, fresh, materialise, read, word_count
from flowcast.operators.ordered import running_total, with_row_index

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 42
MAX_PATTERNS = 20_000
RUN_ROWS = 1 << 16  # equal rows told apart at a time


def targets(sizes: dict, weights: dict, cap: float) -> dict:
    """Shares of the total by weight; a share above ``cap`` times its source's size stops
    there and the excess is shared again by weight among the others."""
    left, active = float(sum(sizes.values())), [s for s in sizes if sizes[s] > 0]
    out = {s: 0.0 for s in sizes}
    while active and left > 0:
        unit = left / sum(weights[s] for s in active)
        over = [s for s in active if unit * weights[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * weights[s] for s in active}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in over]
    return out


def source_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def route(patterns: dict[tuple, int], quotas: dict, max_repeats: int) -> dict[tuple, int]:
    """Tokens taken from each pattern by the cheapest largest flow to the quotas."""
    names, keys = list(quotas), list(patterns)
    at = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    end = 1 + len(keys) + len(names)
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # [to, room, index of reverse]

    def edge(a: int, b: int, room: int) -> list:
        graph[a].append(e := [b, room, len(graph[b])])
        graph[b].append([a, 0, len(graph[a]) - 1])
        return e

    into = [edge(0, 1 + i, 0) for i in range(len(keys))]
    for i, members in enumerate(keys):
        for s in members:
            edge(1 + i, at[s], 1 << 62)
    for s in names:
        edge(at[s], end, quotas[s])

    def augment() -> bool:
        """All shortest augmenting paths of one breadth-first layering."""
        level = [-1] * (end + 1)
        level[0], queue = 0, deque([0])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[end] < 0:
            return False
        tried = [0] * (end + 1)
        path: list[list] = []
        a = 0
        while True:
            if a == end:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                a, path = 0, []
            while tried[a] < len(graph[a]):
                e = graph[a][tried[a]]
                if e[1] > 0 and level[e[0]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(graph[a]):
                path.append(graph[a][tried[a]])
                a = path[-1][0]
            elif path:
                back = path.pop()
                a = graph[back[0]][back[2]][0]
                tried[a] += 1
            else:
                return True

    for _ in range(max_repeats):
        for i, k in enumerate(keys):
            into[i][1] += patterns[k]
        while augment():
            pass
    return {k: max_repeats * patterns[k] - into[i][1] for i, k in enumerate(keys)}


def _goals(patterns: DataFrame, weights: tuple, cap: float) -> DataFrame:
    """(source, n, goal, shared) for each source of ``patterns`` (members, size): its size, its
    target (as :func:`targets` shares them out), and whether a document has it together with
    another. Ranks and sums come from range shuffles, so there may be any number of sources."""
    per = patterns.select(F.explode("members").alias("source"), "size", (F.size("members") > 1).alias("shared")) \
        .groupBy("source").agg(F.sum("size").alias("n"), F.max("shared").alias("shared")).withColumn("last", F.col("source").isNull())
    ranked = with_row_index(per, ["last", "source"], (), "at")  # by code point, null last
    kind = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    sized = materialise(ranked.select("source", "n", "shared", "at", kind.alias("w")), "mix-sources")
    # from the smallest size a weight on, sources are capped until a share stays below its cap
    line = sized.where("n > 0").select("source", "n", "at", "w", (F.col("n") / F.col("w")).alias("ratio"), (F.lit(cap) * F.col("n")).alias("most"))
    line = running_total(line, ["ratio", "at"], (), "capped", "most", "all_most")
    line = running_total(line, ["ratio", "at"], (), "closed_w", "w", "all_w")
    unit = (F.col("all_most") / cap - F.col("capped")) / (F.col("all_w") - F.col("closed_w"))
    found = line.withColumn("unit", unit).where(F.col("unit") * F.col("w") <= F.col("most")).agg(
        F.min_by("unit", F.struct("ratio", "at")).alias("unit"))
    out, s = with_scalars(sized, found, "mix_unit")
    goal = F.when(F.col("n") > 0, F.least(s["unit"] * F.col("w"), F.lit(float(cap)) * F.col("n"))).otherwise(0.0)
    return out.select("source", "n", goal.alias("goal"), "shared")


def _plan(spark: SparkSession, patterns: DataFrame, weights: tuple, max_repeats: int, max_patterns: int) -> DataFrame:
    """(members, source_size, target, whole, rest) for every pattern: sources that no document
    shares fill their quota from their own pattern; the flow on the driver is for the others."""
    goals = materialise(_goals(patterns, weights, max_repeats), "mix-goals")
    total = goals.agg(F.sum("goal").alias("total"))
    # the whole corpus is shared out: overlapping sizes count once
    scale = patterns.where(F.size("members") > 0).agg(F.sum("size").alias("scale"))
    quota, t = with_scalars(goals, total, "mix_total")
    quota, c = with_scalars(quota, scale, "mix_scale")
    goals = materialise(quota.select("source", "n", "goal", "shared", F.coalesce(F.bround(F.try_divide(
        F.col("goal") * c["scale"], t["total"])), F.lit(0.0)).cast("long").alias("quota")), "mix-quotas")
    each = patterns.select("members", "size", F.posexplode_outer("members").alias("place", "member"))
    joined = each.join(goals, F.col("place").isNotNull() & F.col("member").eqNullSafe(F.col("source")), "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct(
        "place", "n", "goal", "quota", "shared", "member"))))
    whole = materialise(joined.groupBy("members", "size").agg(listed.alias("of")), "mix-patterns")
    alone = ~F.exists("of", lambda m: m["shared"])
    tangled = whole.where(~alone).limit(max_patterns + 1).collect()
    if len(tangled) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns share sources; raise max_patterns or coarsen the sources")
    names = source_order({m["member"] for r in tangled for m in r["of"]})
    quotas = {m["member"]: m["quota"] for r in tangled for m in r["of"]}
    flow = route({tuple(r["members"]): int(r["size"]) for r in tangled}, {s: quotas[s] for s in names}, max_repeats)
    routed = spark.createDataFrame([(list(p), n) for p, n in flow.items()], "routed array<string>, flow bigint")
    most = F.least(F.coalesce(F.get("of", F.lit(0))["quota"], F.lit(0).cast("long")), F.lit(max_repeats) * F.col("size"))
    taken = F.when(alone, most).otherwise(F.coalesce("flow", F.lit(0).cast("long")))
    uses = F.when(F.col("size") > 0, F.least(F.floor(taken / F.col("size")), F.lit(max_repeats))).otherwise(0).cast("long")
    planned = whole.join(routed, F.col("members").eqNullSafe(F.col("routed")), "left").select(
        "members", "size", F.transform("of", lambda m: m["n"]).alias("source_size"), F.transform("of", lambda m: m["goal"]).alias("target"),
        uses.alias("whole"), taken.alias("taken"))
    return materialise(planned.select(F.col("members").alias("plan_members"), "source_size", "target", "whole",
                                      (F.col("taken") - F.col("whole") * F.col("size")).alias("rest")), "mix-plan")


def mix(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id",
        weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
        max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(id, size, members, source_size, target, taken) for every row of ``docs``.

    ``members`` is an array of source names; ``source_size`` and ``target`` are arrays
    alongside it. ``taken`` is a multiple of ``size`` up to ``max_repeats``. All rows with
    one id and size are taken alike only if they are equal in the hash order; equal rows
    follow one another in it."""
    spark = docs.sparkSession
    narrow = materialise(docs.select(
        F.col(id_col).alias("id"), size.alias("size"),
        F.array_sort(F.array_distinct(members)).alias("members"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("u")),
        "mix-sizes")
    patterns = materialise(narrow.groupBy("members").agg(F.sum("size").alias("size")), "mix-sums")
    table = _plan(spark, patterns, weights, max_repeats, max_patterns)
    planned = narrow.join(table, narrow["members"].eqNullSafe(table["plan_members"])).drop("plan_members")

    # where each pattern's running sum in hash order passes its rest
    fine = planned.groupBy("members", F.substring("u", 1, 4).alias("b4")).agg(
        F.sum("size").alias("s"), F.first("rest").alias("rest"))
    coarse = fine.groupBy("members", F.substring("b4", 1, 2).alias("b2")).agg(F.sum("s").alias("s2"))
    upto = Window.partitionBy("members").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("before2", F.coalesce(F.sum("s2").over(upto), F.lit(0)))
    within = Window.partitionBy("members", "b2").orderBy("b4").rowsBetween(Window.unboundedPreceding, -1)
    border = (fine.withColumn("b2", F.substring("b4", 1, 2))
              .join(coarse.select("members", "b2", "before2"), ["members", "b2"])
              .withColumn("before", F.col("before2") + F.coalesce(F.sum("s").over(within), F.lit(0)))
              .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s")))
              .select(F.col("members").alias("edge_members"), F.col("b4").alias("border"), "before"))
    edges = materialise(border, "mix-borders")  # at most one row a pattern
    marked = planned.join(edges, planned["members"].eqNullSafe(edges["edge_members"]), "left") \
        .drop("edge_members").withColumn("b4", F.substring("u", 1, 4))
    # no border: the rest is the whole pattern (it has no size)
    plain = marked.where("border is null or b4 <> border").withColumn(
        "more", F.when(F.col("b4") < F.col("border"), 1).otherwise(0))
    # equal rows follow one another: one row with their number stands for them, and so many
    # of them are taken as fit
    inside = Window.partitionBy("members").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = (marked.where("b4 = border").groupBy("members", "u", "id", "size")
             .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in
                                                  ("source_size", "target", "whole", "rest", "b4", "border", "before")]))
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    fit = F.when(F.col("size") > 0, F.floor((2 * room + F.col("size")) / (2 * F.col("size")))).otherwise(
        F.when(room >= 0, F.col("n")).otherwise(0))
    runs = alike.withColumn("fit", F.greatest(F.least(fit, F.col("n")), F.lit(0)))
    blocks = runs.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN_ROWS).cast("long"))))
    close = (blocks.repartition("u", "first").withColumn("nth", F.explode(F.sequence(
        F.col("first"), F.least(F.col("n"), F.col("first") + RUN_ROWS - 1))))
        .withColumn("more", F.when(F.col("nth") <= F.col("fit"), 1).otherwise(0)).drop("n", "fit", "first", "nth"))
    return plain.unionByName(close).select(
        "id", "size", "members", "source_size", "target",
        (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"),
        (F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)).cast("int").alias("repeats"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, F.array(source_col), word_count(F.col(text_col)), id_col, **options)
    gid, gsource, gsize, reps, size, k = fresh(docs, "mix_id", "mix_source", "mix_size", "mix_repeats", "mix_n", "mix_k")
    # equal rows share a line of the plan; the hash order may pass between them, so the
    # rows of one id, source and size spread their repeats over its rows by number
    share = (taken.groupBy(F.col("id").alias(gid), F.get("members", 0).alias(gsource), F.col("size").alias(gsize))
             .agg(F.sum("repeats").alias(reps), F.count(F.lit(1)).alias(k))
             .where(F.col(reps) > 0))
    on = (F.col(id_col).eqNullSafe(F.col(gid)) & F.col(source_col).eqNullSafe(F.col(gsource))
          & (F.col(size) == F.col(gsize)))
    joined = docs.withColumn(size, word_count(F.col(text_col))).join(share, on)
    once = joined.where(F.col(k) == 1).withColumn(size, F.col(reps))
    # rows stored more than once are few; number them to share the repeats exactly
    number = Window.partitionBy(gid, gsource, gsize).orderBy(F.xxhash64(text_col))
    many = joined.where(F.col(k) > 1).withColumn(size, F.row_number().over(number)).withColumn(
        size, F.floor(F.col(reps) / F.col(k)) + F.when(F.col(size) <= F.col(reps) % F.col(k), 1).otherwise(0))
    every = once.withColumn(size, F.col(size).cast("int")).unionByName(many.withColumn(size, F.col(size).cast("int")))
    return (every.where(F.col(size) > 0)
            .withColumn(size, F.explode(F.sequence(F.lit(1), F.col(size)))).select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = mix(docs, F.array("source"), word_count(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "size", F.get("source_size", 0).alias("source_size"),
                      F.get("target", 0).alias("target"), "taken")


# Every document belongs to one source here, so the flow fills each quota from its own
# source and SQL can state it.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u,
         coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, {MAX_REPEATS} * size AS cap, sum(size) OVER () AS total,
         coalesce(sum({MAX_REPEATS} * size) OVER lower, 0) AS capped,
         sum(w) OVER (ORDER BY size / w DESC, source ROWS UNBOUNDED PRECEDING) AS open_w
  FROM s WHERE size > 0
  WINDOW lower AS (ORDER BY size / w, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), unit AS (
  -- the first source, from the smallest size per weight, that its share does not pass
  SELECT min_by((total - capped) / open_w, size / w) FILTER (WHERE (total - capped) / open_w * w <= cap) AS unit FROM o
), t AS (
  SELECT s.source, s.size, coalesce(least(unit * w, {MAX_REPEATS} * s.size), 0) AS target
  FROM s, unit
), p AS (
  SELECT *, CASE WHEN size > 0 THEN least(floor(round(target) / size), {MAX_REPEATS}) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, p.size AS source_size, target, whole, round(target) - whole * p.size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
