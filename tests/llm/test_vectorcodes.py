import glob
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import vectorcodes as V
from millrace.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def slow(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python's integers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return [], ""
    at = V.cuts(len(good[0][1]), parts)
    vectors = [[v[a:b] for a, b in zip(at, at[1:])] for _, v, _ in good]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in vectors:
                own.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old for e, old in enumerate(books[p])]
    out, sums = [], {}
    for (i, _, label), v in zip(good, vectors):
        got = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sums[label]) for i, c, e, label in out], sha


def run(spark, rows, entries=256, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    coded, books = V.encode(V.scaled_vectors(df), entries=entries, **kw)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in V.with_label_error(coded).collect()]
    return got, V.codebooks_sha256(books)


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=10)], int(i % 3) if i % 5 else None, "x") for i in range(60)]
    rows += [(100, None, 1, None), (101, [float("nan")] * 10, 1, ""), (102, [1.0] * 9 + [None], 1, ""), (103, [1.0], 1, ""), (104, [float("inf")] * 10, 2, "")]
    rows += [(None, rows[0][1], None, ""), (5, rows[6][1], 2, ""), rows[7], rows[7], (200, [1e9] * 10, 7, ""), (201, [-1e9] + [0.0] * 9, 7, "")]
    got, sha = run(spark, rows, entries=12)
    want, want_sha = slow(rows, entries=12)
    assert sha == want_sha
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ties_and_few_rows(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, float(i % 3)], None, "") for i in range(9)]
    for entries in (4, 256):
        got, sha = run(spark, rows, entries=entries)
        want, want_sha = slow(rows, entries=entries)
        assert (sorted(got, key=key), sha) == (sorted(want, key=key), want_sha)


def test_empty(spark):
    for rows in ([], [(1, None, 1, "")]):
        got, sha = run(spark, rows)
        assert got == [] and sha == hashlib.sha256(b"").hexdigest()
    assert run(spark, [(1, [], 1, "")])[0] == [(1, "00000000", 0, 0)]


@pytest.mark.parametrize("size", [1, 2, 16])
def test_tree_takes_subtrees_whole(size):
    rng = np.random.default_rng(size)
    # Tight groups, far apart: whole subtrees have one nearest entry.
    points = np.concatenate([rng.integers(-20, 20, (200, size)) + 1000 * k for k in range(6)])
    book = np.array([[1000 * k] * size for k in range(6)] + [[0] * size])
    tree = V.Tree.build(points)
    whole, entry = [], np.full(len(points), -1)

    def subtree(node, e):
        whole.append(tree.end[node] - tree.start[node])
        assert (tree.total[node] == tree.points[tree.start[node] : tree.end[node]].sum(axis=0)).all()
        entry[tree.start[node] : tree.end[node]] = e

    def rest(node, entries):
        entry[tree.start[node] : tree.end[node]] = entries

    tree.walk(book, subtree, rest)
    d = ((tree.points[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all()
    assert sum(whole) > 0.8 * len(points)
    assert sorted(tree.order) == list(range(len(points)))


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    points = rng.integers(-V.MOST, V.MOST, (90, 3)) // 7 * 7
    book = points[::9]
    tree, entry = V.Tree.build(points), np.full(90, -1)
    tree.walk(book, lambda n, e: entry.__setitem__(slice(tree.start[n], tree.end[n]), e), lambda n, e: entry.__setitem__(slice(tree.start[n], tree.end[n]), e))
    p, b = tree.points.astype(object), book.astype(object)
    assert [min((sum((x - y) ** 2), i) for i, y in enumerate(b))[1] for x in p] == entry.tolist()


def test_against_sql(spark):
    from millrace.llm.queries import QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = QUERIES["op11_vector_codes"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op11_vector_codes']})").fetchall())
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter(F.col("vec_id") < 60).collect()]
    assert run(spark, [(*r, "") for r in rows], entries=20)[1] == slow(rows, entries=20)[1]
