"""Conversation prefix trie with subtree totals by parallel tree contraction.

Every distinct sequence of the first d turns of the conversations is a node of depth d;
its smallest member and its depth name it. Prefixes are told apart by two 64-bit
exclusive-or sums over (turn number, role, text), which a running aggregate extends turn
by turn.

Subtree totals (leaves, saved tokens) need sums from the leaves up, and a chain may be as
long as a conversation. Tree contraction takes a number of join rounds that grows with the
logarithm of the number of nodes instead. A round rakes and then compresses: all leaves
leave and add their totals to their parents; then nodes with one child whose neighbours on
the chain have higher priority leave, hand their total to their parent, and their child
moves up to it. The priority of a node is the number of trailing zero bits of its depth
(ties by hash), so half of a chain goes in each round. Afterwards the rounds are undone
from the last to the first: a node that was compressed has the total it had then plus the
subtree total of the child it had then.

A round only sees nodes still there and writes what leaves in the shared folder, so all
rounds together are linear in the nodes. Parents with very many children are summed with
map-side combining, and what a round joins is written first, so that AQE can split it.

Defined cases: turns are ordered by turn (null first), then role and digest of the text, and
repeated rows are turns of their own; null role or text is empty; rows without a conversation id
take no part; the hundred of a negative id is opened by the multiple of 100 nearer to 0; a conversation without turns ends at the root; an empty table has no node,
not even a root. Names of other columns do not matter, they are not read.
``ends_sha256`` hashes one list of ids a node, which a task holds whole: 8 bytes for each
conversation that ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowcast.llm.common import materialise, read
from flowcast.operators.ordered import CHUNK_ROWS, with_row_index

HUNDRED = 100
HEADS = 6
MAX_ROUNDS = 200


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(c, i, role, text): the turns of each conversation numbered from 0. Numbers come from a
    range shuffle on all keys, so a conversation of very many turns is split."""
    def clean(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    turns = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), clean(role_col).alias("role"),
                        clean(text_col).alias("text")).where(F.col("c").isNotNull())
    # a number that tells equal rows apart has to be written, or the order could change when
    # it is read again; texts are ordered by digest, so that the keys of the ranges stay short
    turns = materialise(turns.withColumns({"k": F.md5("text"), "row": F.monotonically_increasing_id()}), "trie-turns")
    numbered = with_row_index(turns, ["t", "role", "k", "row"], ["c"], "i")
    return materialise(numbered.select("c", "i", "role", "text"), "trie-ordered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, i, role, text) of the rebuilt conversations, and (c, n) for every conversation
    with its number of turns: the first h turns come from the conversation that opens its
    hundred, the others are its own after its first h; h is the CRC-32 of the id modulo 6."""
    h = (F.crc32(F.col("c").cast("string")) % HEADS).cast("long")
    base = F.col("c") - F.col("c") % HUNDRED
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    opened = convs.where(F.col("c") % HUNDRED == 0).select(F.col("c").alias("b"), F.col("own").alias("base_turns"))
    convs = convs.withColumns({"h": h, "b": base}).join(opened, "b", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long"))))
    convs = materialise(convs.select("c", "b", "h", "head", (F.col("head") + F.greatest(
        F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("n")), "trie-conversations")
    # at most HEADS - 1 rows of an opening conversation meet its at most HUNDRED followers
    first = turns.where((F.col("c") % HUNDRED == 0) & (F.col("i") < HEADS - 1)).select(F.col("c").alias("b"), "i", "role", "text")
    heads = convs.where("head > 0").select("c", "b", "head").join(first, "b").where(F.col("i") < F.col("head"))
    # the shift of a conversation's own turns travels as one row a conversation
    shift = materialise(convs.select(F.col("c").alias("own_c"), "h", "head"), "trie-shift")
    own = turns.join(shift, F.col("c") == F.col("own_c")).where(F.col("i") >= F.col("h")).withColumn(
        "i", F.col("i") - F.col("h") + F.col("head"))
    return (heads.select("c", "i", "role", "text").unionByName(own.select("c", "i", "role", "text")),
            convs.select("c", "n"))


def _prefix_keys(turns: DataFrame, chunk_rows: int) -> DataFrame:
    """(c, d, p1, p2, q1, q2, size): the prefix of d turns that ends in each turn, the one
    before it, and code points of the last text. Long conversations are cut into chunks of
    ``chunk_rows`` turns; the sums of earlier chunks are added to each."""
    marks = turns.select(
        "c", "i", F.floor(F.col("i") / chunk_rows).alias("part"), F.length("text").cast("long").alias("size"),
        F.xxhash64("i", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "i").alias("b"))
    marks = materialise(marks, "trie-marks")
    sums = marks.groupBy("c", "part").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carry = sums.select(
        F.col("c").alias("carry_c"), F.col("part").alias("carry_part"),
        F.coalesce(F.bit_xor("sa").over(before), zero).alias("ca"), F.coalesce(F.bit_xor("sb").over(before), zero).alias("cb"))
    upto = Window.partitionBy("c", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inside = marks.withColumns({"xa": F.bit_xor("a").over(upto), "xb": F.bit_xor("b").over(upto)})
    whole = inside.join(carry, (F.col("c") == F.col("carry_c")) & (F.col("part") == F.col("carry_part")))
    p1, p2 = F.col("xa").bitwiseXOR(F.col("ca")), F.col("xb").bitwiseXOR(F.col("cb"))
    return whole.select("c", (F.col("i") + 1).alias("d"), p1.alias("p1"), p2.alias("p2"),
                        p1.bitwiseXOR(F.col("a")).alias("q1"), p2.bitwiseXOR(F.col("b")).alias("q2"), "size")


def nodes(turns: DataFrame, convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(c, d, parent, n_convs, size, ends): the nodes of the trie over (c, i, role, text) and
    (c, n), named by smallest member and depth; ``ends`` are the members of d turns."""
    prefixes = _prefix_keys(turns, chunk_rows)
    zero = F.lit(0).cast("long")
    root = convs.select("c", zero.alias("d"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"),
                        F.lit(None).cast("long").alias("q2"), zero.alias("size"))
    every = materialise(prefixes.unionByName(root), "trie-prefixes")
    keyed = every.groupBy("d", "p1", "p2").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.first("size").alias("size"))
    keyed = materialise(keyed, "trie-keyed")
    # conversations that end in a node, by the key of their last prefix
    last = every.join(convs.select(F.col("c").alias("end_c"), F.col("n").alias("end_n")),
                      (F.col("c") == F.col("end_c")) & (F.col("d") == F.col("end_n")))
    ends = last.groupBy(F.col("d").alias("e_d"), F.col("p1").alias("e1"), F.col("p2").alias("e2")).agg(
        F.array_sort(F.collect_list("c")).alias("ends"))
    parents = keyed.select(F.col("d").alias("up_d"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("c").alias("parent"))
    return (keyed.join(parents, (F.col("d") - 1 == F.col("up_d")) & (F.col("q1") == F.col("up1")) & (F.col("q2") == F.col("up2")), "left")
            .join(ends, (F.col("d") == F.col("e_d")) & (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left")
            .select("c", "d", "parent", "n_convs", "size", F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends")))


def _priority(depth: Column, c: Column) -> Column:
    """Trailing zero bits of the depth, then a hash: the same for a node in every round."""
    low = depth.bitwiseAND(-depth)
    return F.struct(F.bit_count(low - 1).alias("zeros"), F.xxhash64(c, depth).alias("tie"), c.alias("c"), depth.alias("d"))


def subtree_sums(tree: DataFrame, values: list[str], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(c, d, values...): sums of the ``values`` columns over the subtree of every node of
    ``tree`` (c, d, pc, pd, n_kids, values...); the root has null pc and pd, ``n_kids`` is the
    number of children. Nodes are (c, d) pairs and need not be one deeper than their parents."""
    now = materialise(tree.select("c", "d", "pc", "pd", "n_kids", *values), "trie-live")
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    itself = (F.col("c") == F.col("k_c")) & (F.col("d") == F.col("k_d"))

    def of_children(frame: DataFrame, *aggs: Column) -> DataFrame:
        return frame.where("pc is not null").groupBy(F.col("pc").alias("k_c"), F.col("pd").alias("k_d")).agg(*aggs)

    for _ in range(max_rounds):
        if now.count() <= 1:
            break
        # rake: nodes without children leave, their totals go up
        leaves = now.where("n_kids = 0 and pc is not null")
        raked.append(leaves.select("c", "d", *values))
        up = of_children(leaves, F.count(F.lit(1)).alias("n_gone"), *[F.sum(v).alias(f"up_{v}") for v in values])
        stay = now.where("n_kids > 0 or pc is null").join(up, itself, "left").select(
            "c", "d", "pc", "pd", (F.col("n_kids") - F.coalesce("n_gone", F.lit(0))).alias("n_kids"),
            *[(F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values])
        stay = materialise(stay, "trie-stay")
        # compress: of the nodes with one child, those of least priority among their neighbours
        # on the chain leave; so no two neighbours do
        chain = stay.withColumn("pri", F.when((F.col("n_kids") == 1) & F.col("pc").isNotNull(), _priority(F.col("d"), F.col("c"))))
        below = of_children(chain, F.min(F.struct("c", "d")).alias("kid"), F.min("pri").alias("kid_pri"))
        above = chain.select(F.col("c").alias("a_c"), F.col("d").alias("a_d"), F.col("pri").alias("above_pri"))
        chosen = (chain.where("pri is not null").join(below, itself)
                  .join(above, (F.col("pc") == F.col("a_c")) & (F.col("pd") == F.col("a_d")))
                  .where((F.col("kid_pri").isNull() | (F.col("pri") < F.col("kid_pri")))
                         & (F.col("above_pri").isNull() | (F.col("pri") < F.col("above_pri"))))
                  .select("c", "d", "pc", "pd", F.col("kid.c").alias("kid_c"), F.col("kid.d").alias("kid_d"), *values))
        chosen = materialise(chosen, "trie-spliced")
        spliced.append(chosen)
        # the child moves up to the parent, so both keep their numbers of children
        gone = chosen.select(F.col("c").alias("g_c"), F.col("d").alias("g_d"), F.col("pc").alias("g_pc"), F.col("pd").alias("g_pd"))
        gain = chosen.select("pc", "pd", *values).groupBy(F.col("pc").alias("t_c"), F.col("pd").alias("t_d")) \
            .agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        now = (stay.join(gone.select("g_c", "g_d"), (F.col("c") == F.col("g_c")) & (F.col("d") == F.col("g_d")), "left_anti")
               .join(gone, (F.col("pc") == F.col("g_c")) & (F.col("pd") == F.col("g_d")), "left")
               .join(gain, (F.col("c") == F.col("t_c")) & (F.col("d") == F.col("t_d")), "left")
               .select("c", "d", F.coalesce("g_pc", "pc").alias("pc"), F.coalesce("g_pd", "pd").alias("pd"), "n_kids",
                       *[(F.col(v) + F.coalesce(f"t_{v}", F.lit(0))).alias(v) for v in values]))
        now = materialise(now, "trie-live")
    else:
        raise RuntimeError("the tree did not contract")
    # undo the rounds: what is known after round t are the nodes that left later
    known = [now.select("c", "d", *values)]
    for leaves, chosen in zip(reversed(raked), reversed(spliced)):
        all_known = known[0]
        for part in known[1:]:
            all_known = all_known.unionByName(part)
        child = all_known.select(F.col("c").alias("kid_c"), F.col("d").alias("kid_d"), *[F.col(v).alias(f"kid_{v}") for v in values])
        back = chosen.join(child, ["kid_c", "kid_d"]).select(
            "c", "d", *[(F.col(v) + F.col(f"kid_{v}")).alias(v) for v in values])
        known += [materialise(back, "trie-back"), leaves]
    out = known[0]
    for part in known[1:]:
        out = out.unionByName(part)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The trie over (c, i, role, text) and (c, n): (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends), one row a node."""
    found = materialise(nodes(turns, convs, chunk_rows), "trie-nodes")
    up = found.where("parent is not null").groupBy(F.col("parent").alias("u_c"), (F.col("d") - 1).alias("u_d")).agg(
        F.count(F.lit(1)).alias("n_children"))
    up = materialise(up, "trie-degrees")
    found = materialise(found.join(up, (F.col("c") == F.col("u_c")) & (F.col("d") == F.col("u_d")), "left").select(
        "c", "d", "parent", "n_convs", "size", "ends", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")),
        "trie-degreed")
    tree = found.select("c", "d", F.col("parent").alias("pc"), F.when(F.col("parent").isNotNull(), F.col("d") - 1).alias("pd"),
                        F.col("n_children").alias("n_kids"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    return found.join(sums, ["c", "d"]).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", "ends")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns, convs = rebuilt(ordered_turns(rows))
    ids = F.array_join(F.transform("ends", lambda c: c.cast("string")), ",")
    return prefix_trie(turns, convs).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.sha2(ids, 256).alias("ends_sha256"))


SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list({{'role': role, 'body': body}} ORDER BY turn NULLS FIRST, role, md5(body)) AS turns FROM t GROUP BY c
), h AS (
  SELECT c, c - c % {HUNDRED} AS b, turns, crc32_of.h AS h
  FROM o JOIN (SELECT c AS hc, CAST(
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(CAST(c AS VARCHAR))),
      lambda i: ascii(substr(CAST(c AS VARCHAR), i + 1, 1))::BIGINT)), lambda crc, x:
        list_reduce(list_prepend(xor(crc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                    lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))) AS BIGINT) AS raw,
    xor(raw, 4294967295::BIGINT) % {HEADS} AS h FROM o) crc32_of ON hc = c
), r AS (
  SELECT h.c, list_concat(coalesce(list_slice(base.turns, 1, h.h), CAST([] AS STRUCT(role VARCHAR, body VARCHAR)[])),
                          list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN o base ON base.c = h.b
), p AS (
  SELECT c, d, len(turns) AS n, list_slice(turns, 1, d) AS prefix
  FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r) q
), keyed AS (
  SELECT c, d, n, md5(CAST(to_json(prefix) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN length(prefix[d].body) ELSE 0 END AS size,
         CASE WHEN d > 0 THEN md5(CAST(to_json(list_slice(prefix, 1, d - 1)) AS VARCHAR)) END AS up
  FROM p
), node AS (
  SELECT d, k, min(c) AS c, any_value(up) AS up, any_value(size) AS size, count(*) AS n_convs,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM keyed GROUP BY d, k
), linked AS (
  SELECT n.*, u.c AS parent, (SELECT count(*) FROM node x WHERE x.d = n.d + 1 AND x.up = n.k) AS n_children
  FROM node n LEFT JOIN node u ON u.d = n.d - 1 AND u.k = n.up
), above AS (
  -- each node with every node on its path, by one of its members
  SELECT l.d, l.k, a.d AS ad, a.k AS ak, l.n_children, (l.n_convs - 1) * l.size AS saved
  FROM linked l JOIN keyed a ON a.c = l.c AND a.d <= l.d
), sums AS (
  SELECT ad, ak, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ad, ak
)
SELECT c AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
       CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM linked JOIN sums ON ad = d AND ak = k
"""
