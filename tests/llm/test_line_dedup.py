import random

import duckdb

from flowcast.llm import line_dedup

SCHEMA = "doc_id long, text string, id string, k string, gone string, h1 string"


def slow(rows, size=3):
    """Later occurrences by (id, text as stored, position); ids here are distinct or rows equal."""
    windows = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [n for n, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        for p in range(len(at) - size + 1):
            use = at[p:p + size]
            windows.setdefault(tuple(lines[n] for n in use), set()).add((i is not None, i, t, p, tuple(use)))
    gone = {}
    for places in windows.values():
        first = min((x[0], x[1] if x[0] else 0, x[3]) for x in places)
        for x in places:
            if (x[0], x[1] if x[0] else 0, x[3]) != first:
                gone.setdefault((x[1], x[2]), set()).update(x[4])
    out = []
    for i, t in rows:
        g = gone.get((i, t), set())
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g), len(g)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(rng.choice(["a", "b", "c", "d e", "", "  ", "é"]) for _ in range(rng.randint(0, 12)))))
    return rows + [(100, None), (101, ""), (102, "a\na\na\na\na"), (103, "\n\n\n"), (104, "x\n\ny\n \nz"), (105, "x\ny\nz"),
                   (106, "one\ntwo"), (107, "a\r\nb\r\nc")]


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "i", "k", "g", "h") for i, t in rows], SCHEMA)
    out = line_dedup.remove_repeated_lines(df, removed_col="n")
    assert out.columns == [*df.columns, "n"]
    return sorted(((r["doc_id"], r["text"], r["n"]) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        assert got(spark, corpus(seed)) == slow(corpus(seed))


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "p\nq\nr\ns"), (5, "p\nq\nr"), (5, "p\nq\nr"), (6, "q\nr\ns")]
    assert got(spark, rows) == slow(rows)
    assert [r[1] for r in got(spark, rows) if r[0] == 5] == ["", ""]


def test_copies_without_an_id_are_documents_of_their_own(spark):
    rows = [(None, "p\nq\nr")] * 4 + [(None, "a\n\nb\nc\nx")] * 2 + [(7, "a\nb\nc"), (8, "u\nv\nw"), (8, "u\nv\nw")]
    texts = sorted((r[:2] for r in got(spark, rows)), key=str)
    assert texts == sorted([(None, "p\nq\nr"), (None, ""), (None, ""), (None, ""), (None, "a\n\nb\nc\nx"), (None, ""),
                            (7, ""), (8, "u\nv\nw"), (8, "u\nv\nw")], key=str)


def test_sql_twin(spark):
    rows = corpus(3)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted((r[0], r[2]) for r in con.execute(line_dedup.SQL).fetchall())
    assert want == sorted((r[0], r[2]) for r in got(spark, rows))


def test_empty_table_and_long_document(spark):
    assert got(spark, []) == []
    lines = [f"line {n % 5000}" for n in range(20000)]
    (_, text, n), = got(spark, [(1, "\n".join(lines))])
    assert n == 15000 and text == "\n".join(lines[:5000])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "i", "k", "g", "h")], SCHEMA)
    plan = line_dedup.remove_repeated_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
