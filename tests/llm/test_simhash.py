import random
import re

import numpy as np
import xxhash

from flowcast.llm import simhash
from flowcast.llm.components import connected_components, roots

SCHEMA = "doc_id long, text string, fp string, id string, component_id string"


def slow_fingerprint(text, k=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, radius=4):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                top[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(fps):
        r = find(n)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{fp:016x}", least.get(find(n))) for n, (i, fp) in enumerate(fps)), key=str)


def rows(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"Wörd{rng.randint(0, 999)}" for _ in range(300)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            j = rng.randrange(len(base))
            out.append(" \t".join(base[:j] + ["NEW"] + base[j + 1:]))
    out += ["", None, "one", "one two three", " \n", out[0], "one two", "İ K ſ"]
    return list(enumerate(out))


def result(spark, data, **kw):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], SCHEMA)
    got = simhash.groups(df, **kw).collect()
    return sorted(((r["id"], f"{r['fp'] & (2 ** 64 - 1):016x}", r["component_id"]) for r in got), key=str)


def test_matches_brute_force(spark):
    data = rows()
    assert result(spark, data) == slow_components(data)


def test_small_tiles_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKS_HELD", 3)
    data = rows(2, 30)
    data += [data[3], data[3], (None, data[4][1]), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    fps = df.select(simhash.fingerprint(df.text).alias("fp")).distinct()
    edges = simhash.links(fps, 4, tile_rows=2).collect()
    assert edges
    assert result(spark, data) == slow_components(data)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one(spark):
    data = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "x y z"), (None, "only null id here now")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 9, None]


def test_keep_one_takes_one_of_each_group_whatever_the_ids(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(7)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2])]  # three groups without an id
    data += [(4, texts[3]), (4, texts[4]), (8, texts[4])]  # one id with two unrelated texts
    data += [(None, texts[5]), (6, texts[5]), (7, texts[6])]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    want = [(None, t) for t in texts[:3]] + [(4, texts[3]), (4, texts[4]), (6, texts[5]), (7, texts[6])]
    assert got == sorted(want, key=str)


def test_tile_links_keep_every_connection():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40, np.uint64)
    all_ = np.unique(np.concatenate([base ^ np.uint64(1 << b) for b in range(12)] + [base]))
    member, root = simhash.tile_links(all_, all_, 4)
    at = {int(x): i for i, x in enumerate(all_)}
    mine = roots(np.array([at[int(x)] for x in member]), np.array([at[int(x)] for x in root]), len(all_))
    far = np.bitwise_count(all_[:, None] ^ all_[None, :])
    u, v = np.nonzero(far <= 4)
    assert (mine == roots(u, v, len(all_))).all()


def test_tiles_of_neighbouring_population_counts_keep_every_link():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2 ** 64, 20_000, np.uint64)
    a = x[np.bitwise_count(x) == 31][:1500]
    b = [x[np.bitwise_count(x) == 33][:1500]]
    for v in a[:300]:  # two bits on, or three on and one off
        zeros = rng.permutation([i for i in range(64) if not int(v) >> i & 1])
        ones = rng.permutation([i for i in range(64) if int(v) >> i & 1])
        for flips in ((*zeros[:2],), (*zeros[:3], ones[0])):
            b.append(np.array([int(v) ^ sum(1 << int(i) for i in flips)], np.uint64))
    b = np.unique(np.concatenate(b))
    u, v = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4)
    both = np.concatenate((a, b))
    want = roots(u, v + len(a), len(both))
    member, root = simhash.tile_links(a, b, 4)
    at = {int(y): i for i, y in enumerate(both)}
    got = roots(np.array([at[int(y)] for y in member]), np.array([at[int(y)] for y in root]), len(both))
    assert len(member) >= 600
    assert (got == want).all()


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[300], names[i]) for i in range(301, 400)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[names[i]] for i in range(200)} == {min(names[:200])}
    assert {got[names[i]] for i in range(300, 400)} == {min(names[300:])}
    assert len(got) == 300
