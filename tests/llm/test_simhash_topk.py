import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash, topk
from millrace.llm.common import documents
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    p = sorted(parent)
    for i, x in enumerate(p):
        for y in p[:i]:
            if (x ^ y).bit_count() <= 3:
                parent[root(x)] = root(y)
    return {x: root(x) for x in p}


def test_fingerprint():
    for t in [None, "", " \n", "One", "one two", "A b C d é É", "a\x85b c\xa0d e f", "x " * 70000 + "y"]:
        assert simhash.fingerprint(t) == slow_print(t)


def test_near_duplicates(spark):
    docs = documents(spark, SF)
    texts = [r["text"] for r in docs.limit(40).collect()]
    more = [(1000 + i, t[:-1] + " end" if i % 2 else t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (None, texts[0]), (5002, texts[3]), (5002, texts[3])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("fp", F.lit("x"))
    rows = docs.collect()
    fp = {r["text"]: slow_print(r["text"]) for r in rows}
    comp = slow_components(fp.values())
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            c = comp[fp[r["text"]]]
            least[c] = min(least.get(c, 1 << 60), r["doc_id"])
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, fp[r["text"]], least[comp[fp[r["text"]]]]) for r in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(120)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = slow_components(fps)
    for most in (10**6, 20):
        got = {(r["node"] % (1 << 64)): r["component"] for r in components(simhash.links(df, most=most)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(f)
        for g in groups.values():
            assert len({got.get(f, f) for f in g}) == 1
        assert len({got.get(f, f) for f in fps}) == len(groups)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(chain.limit(0)).count() == 0


def slow_top(rows, k=5):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.setdefault((i, tuple(math.floor(256 * x) for x in e)))
    out = []
    for (i, q) in v:
        if i % 50 == 0:
            s = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(q, w))), j) for j, w in v if j != i and len(w) == len(q))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def test_topk_tells_large_ids_apart(spark):
    rows = [(2**60, [1.0, 2.0]), (2**60 + 1, [1.0, 2.0]), (2**60 + 1, [1.0, 2.0]), (50, [0.0, 1.0]), (-(2**60), [0.0, -0.0]), (-(2**60), [0.0, 0.0]), (51, [-0.0, 0.5])]
    v = topk.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1))
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id = 50")).collect()))
    assert got == [r for r in slow_top(rows) if r[0] == 50] and {r[2] for r in got} == {2**60, 2**60 + 1, -(2**60), 51}


def test_topk(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, topk.op8_topk(spark, SF).collect()))
    assert got == slow_top(rows)
    odd = [(100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (50, [1e18, 2.0]), (51, [1e18, 3.0]), (0, [0.5, 0.25]), (3, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [1.0, 1.0]), (250, [1.0])]
    odd += [(1000 + i, [0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    monkeypatch.setattr(topk, "BLOCK", 2)
    v = topk.sound_vectors(df.repartition(3))
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0")).collect()))
    assert got == slow_top(odd)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    many = topk.sound_vectors(spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(400)], "vec_id long, embedding array<double>").repartition(10))
    got = sorted(map(tuple, topk.top_k(many, many.filter("vec_id % 50 = 0")).collect()))
    assert got == slow_top([(i, [float(i % 7), float(i % 11)]) for i in range(400)])


def test_similar_documents_against_brute_force(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijkl", k=6))
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    docs = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(90, 300))]
        for _ in range(8):
            own = list(base)
            for k in r.sample(range(len(own)), r.randint(1, 6)):
                own[k] = word()
            docs.append(own)
    docs += [[word() for _ in range(100)] for _ in range(30)] + [["a", "b"], ["b", "a"], ["a", "b"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {x["id"]: (x["group"], x["group_g"]) for x in simhash.similar(df).collect()}
    sets, pairs, found = [shingles(t) for t in docs], 0, 0
    for i in range(len(docs)):
        for j in range(i):
            alike = docs[i] == docs[j] or bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            pairs, found = pairs + alike, found + (alike and got[i] == got[j])
            assert docs[i] != docs[j] or got[i] == got[j]
            assert i < 96 and i // 8 == j // 8 or got[i] != got[j] or docs[i] == docs[j]
    assert pairs > 60 and found >= 0.95 * pairs


def test_crowded_segments_link_all_the_same(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda **k: simhash.similar(df, **k).select("group").distinct().count()
    assert groups() == 1 and groups(most=5) == 1
    assert simhash.similar(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_give_the_same_lists(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(120, 6)))]
    v = topk.sound_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 3 = 0")).collect()))
    monkeypatch.setattr(topk, "BLOCK", 7)
    assert len(whole) == 200 and sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 3 = 0")).collect())) == whole
