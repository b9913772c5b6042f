import hashlib
import random
from zlib import crc32

import duckdb

from flowcast.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, c string, i int"  # the last two clash with inner names


def slow_rebuilt(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(),
                                            text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]  # % has the sign of c
    return out


def slow(rows):
    convs = slow_rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])),
                    sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, tmp_path, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = P.query(spark, str(tmp_path))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def corpus(seed):
    """Few roles and texts, so that prefixes meet; some hundreds lack their first conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 112), *range(205, 230), 300, -7, -100, 4_000_000_000]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "bot", None]), rng.choice(["a", "é", "", None])))
    return rows


def test_matches_brute_force_and_twin(spark, tmp_path):
    rows = corpus(1)
    out = got(spark, rows, tmp_path)
    assert out == slow(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(P.SQL).fetchall()) == out


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, None, None)]
    rows += [(3, t, "r", "longer text " * 5000) for t in range(9)]  # long texts
    assert got(spark, rows, tmp_path) == slow(rows)


def test_empty_table(spark, tmp_path):
    assert got(spark, [], tmp_path) == []


def test_many_copies_and_one_long_conversation(spark):
    """A chain of 700 turns in chunks of 64, and a node that 200 conversations share."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(700)] + [(1000 + c, 0, "user", "same") for c in range(200)]
    turns = P.ordered_turns(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA))
    convs = turns.groupBy("c").count().withColumnRenamed("count", "n")
    out = {(r["conv_id"], r["depth"]): r for r in P.prefix_trie(turns, convs, chunk_rows=64).collect()}
    assert len(out) == 1 + 700 + 1
    root, hot = out[(1, 0)], out[(1000, 1)]
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (201, 2, 2, 199 * 4)
    assert (hot["n_convs"], hot["n_children"], hot["ends"]) == (200, 0, list(range(1000, 1200)))
    assert all((out[(1, d)]["n_leaves"], out[(1, d)]["saved_tokens"], out[(1, d)]["parent_conv_id"]) == (1, 0, 1)
               for d in range(1, 701))


def test_contraction_sums_every_subtree(spark):
    """A root over a chain, a star, a random tree and a comb."""
    rng = random.Random(4)
    parent = {0: None}
    shapes = {"chain": lambda v, a: v - 1, "star": lambda v, a: a, "random": lambda v, a: rng.randint(a, v - 1),
              "comb": lambda v, a: v - 1 if v % 2 else max(v - 2, a)}
    for j, up in enumerate(shapes.values()):
        a = 1 + 120 * j
        parent |= {a: 0} | {v: up(v, a) for v in range(a + 1, a + 120)}
    depth = {0: 0}
    for v in range(1, len(parent)):
        depth[v] = depth[parent[v]] + 1
    value = {v: rng.randint(-5, 50) for v in parent}
    total = dict(value)
    for v in range(len(parent) - 1, 0, -1):
        total[parent[v]] += total[v]
    kids = list(parent.values())
    rows = [(v, depth[v], p, None if p is None else depth[p], kids.count(v), value[v]) for v, p in parent.items()]
    tree = spark.createDataFrame(rows, "c long, d long, pc long, pd long, n_kids long, x long").coalesce(2)
    out = P.subtree_sums(tree, ["x"], max_rounds=12)  # far fewer rounds than the chain is long
    assert {r["c"]: r["x"] for r in out.collect()} == total
