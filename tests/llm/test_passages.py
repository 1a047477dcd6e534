import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import near, passages
from millrace.llm.common import FILE_CLEANUP, documents, materialize

SF = "/root/testdata/sf0.001"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def test_paragraphs_cover_the_text():
    text = "Ein kurzer Satz hier.\n\n" + words(1, 200) + "\n é ü\tx"
    start, end, n, h, at = passages.paragraphs(text)
    assert sum(n) == len(text.split()) == len(h)
    assert " ".join(" ".join(text[a:b].split()) for a, b in zip(start, end)) == " ".join(text.split())
    assert len(passages.paragraphs(None)[0]) == len(passages.paragraphs(" \n")[0]) == 0


def test_planted_passages(spark):
    rows, planted = [], set()
    for k in range(20):
        p = words(100 + k, 51 + k)
        for j in range(2 + k % 3):
            d = 1000 + 10 * k + j
            planted.add(d)
            rows.append((d, words(d, 60) + " " + p + " " + words(-d, 40)))
    clean = [(i, words(5000 + i, 300) + "\nAll rights reserved.\n" + words(9000 + i, 30)) for i in range(100)]
    odd = [(None, None), (7000, None), (7001, ""), (7002, "x " * 3000), (None, rows[0][1])]
    df = spark.createDataFrame(rows + clean + odd + rows[:1], "doc_id long, text string").withColumn("h", F.lit(1))
    got = passages.repeated(df).collect()
    assert {r["id"] for r in got} - {None} == planted
    kept = {}
    for r in got:
        if not r["removed"]:
            assert kept.setdefault(r["class_id"], r) is r
    text = dict(rows)
    for r in got:
        if r["id"] is not None:
            assert r["n"] == len(text[r["id"]][r["start"] : r["end"]].split())
    left = {r["doc_id"]: r["text"] for r in passages.without(df, passages.repeated(df)).collect()}
    assert all(left[d] == t for d, t in clean) and len(left[1001]) < len(text[1001])


def test_near_paragraphs_link(spark):
    base = words(3, 48)
    near = base.rsplit(" ", 1)[0] + " other"
    df = spark.createDataFrame([(1, base), (2, near), (3, base.upper() + "."), (4, words(4, 48))], "doc_id long, text string")
    got = passages.repeated(df).collect()
    assert {r["id"] for r in got} == {1, 2, 3} and len({r["class_id"] for r in got}) == 1
    assert [r["id"] for r in got if not r["removed"]] == [1]


def test_forest_is_exact():
    r = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(40)[r.random(40) > 0.08], r.integers(1000, 1400, 3)])) for _ in range(60)]
    a, b, reps = near.linked(list(range(60)), sets, 0.8)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(60):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8:
                root[find(i)] = find(j)
    assert len({find(i) for i in range(60)}) == len(reps) and len(a) == 60 - len(reps)
    assert all(find(x) == find(y) for x, y in zip(a, b))


def test_empty(spark):
    assert passages.repeated(documents(spark, SF).limit(0)).count() == 0


def test_dealt_classes_give_the_same_rows(spark, monkeypatch):
    docs = documents(spark, SF)
    rows = lambda: sorted(map(repr, passages.repeated(docs).collect()))
    whole = rows()
    monkeypatch.setattr(passages, "DEALT", 3)
    assert whole and rows() == whole


def test_lots_lose_no_link(monkeypatch):
    import pyarrow as pa

    # 1 and 2 are alike, 3 is alike to 2 but not to 1, and comes in a later lot.
    sets = [list(range(0, 40)), list(range(4, 44)), list(range(8, 48)), list(range(900, 940)), list(range(904, 944))]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 5), pa.array([1, 2, 3, 4, 5]), pa.array(sets, pa.list_(pa.int64()))], ["band", "h", "set"])
    monkeypatch.setattr(near, "LOT", 2)
    got = [tuple(sorted(x)) for out in near.verify(iter([batch])) for x in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(got) == [(1, 2), (2, 3), (4, 5)]


def test_short_and_long_paragraphs_link_when_near(spark):
    short, long = words(21, 9), words(22, 52)
    changed = long.split()
    changed[26] = "other"
    lead = words(23, 19)
    rows = [(1, lead + "\n" + short), (2, lead + "\n" + short + " more"), (3, long), (4, " ".join(changed)), (5, words(24, 60))]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {(r["id"], r["n"]) for r in got if r["removed"]}
    assert removed >= {(2, 19), (2, 10), (4, 52)} and {i for i, _ in removed} == {2, 4}


def test_piece_stays_when_its_first_goes_with_a_line(spark):
    line, tail = words(31, 150), words(32, 60)
    rows = [(1, line), (2, line + " " + words(33, 20)), (3, words(34, 80) + " " + tail), (4, tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = " ".join(r["text"] for r in passages.without(df, passages.repeated(df)).collect())
    assert all(w in left.split() for text in (line, tail) for w in text.split())


def test_passage_is_found_however_it_is_wrapped(spark):
    p = words(41, 90).split()
    wrapped = "\n".join(" ".join(p[i : i + 12]) for i in range(0, 90, 12))
    rows = [(1, words(42, 30) + " " + " ".join(p)), (2, wrapped), (3, words(43, 50)), (4, words(43, 50) + " more")]
    got = [r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed"]]
    assert sum(r["n"] for r in got if r["id"] == 2) >= 60 and {r["id"] for r in got} == {2, 4}


def test_passage_of_short_lines_is_found(spark):
    p = words(51, 120).split()
    verse = "\n".join(" ".join(p[i : i + 3]) for i in range(0, 120, 3))
    p = words(52, 130).split()
    turns = "\n".join(" ".join(p[i : i + 10]) + "\n" + " ".join(p[i + 10 : i + 13]) for i in range(0, 130, 13))
    rows = [(i, words(60 + i, 30) + "\n" + (verse if i < 2 else turns) + "\n" + words(70 + i, 30)) for i in range(4)]
    rows += [(9, words(80, 40) + "\nthe end"), (10, words(81, 40) + "\nthe end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated(df)
    assert {r["id"] for r in found.filter("removed").collect()} == {1, 3}
    left = {r["doc_id"]: len(r["text"].split()) for r in passages.without(df, found).collect()}
    assert left[0] == 180 and left[2] == 190 and left[1] <= 90 and left[3] <= 90 and left[10] == 42


def _variants(seed, n, length=40):
    """n variants of one line, each with one or two words of its own, so that some are near to others only through a third."""
    r, base = random.Random(seed), words(seed, length).split()
    for i in range(n):
        own = list(base)
        for k in r.sample(range(length), r.randint(1, 2)):
            own[k] = f"w{seed}x{i}"
        yield " ".join(own)


def _jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _groups(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_whole_query_against_brute_force(spark):
    lines = [t for seed, n in ((301, 30), (302, 12), (303, 2)) for t in _variants(seed, n)]
    twelve = words(310, 24)
    lines += [twelve, twelve + " more", words(311, 25), words(312, 60), words(313, 30)]
    rows = [(i, t) for i, t in enumerate(lines)]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).filter("n >= 24").collect()
    have = {}
    for r in got:
        have.setdefault(r["class_id"], set()).add(r["id"])
    want = _groups(list(range(len(lines))), lambda i, j: _jaccard(lines[i], lines[j]) >= 0.8 - 1e-9)
    assert {frozenset(v) for v in have.values() if len(v) > 1} == want
    # Every class keeps its first line, and counts its documents.
    for r in got:
        assert r["removed"] == (r["id"] != min(have[r["class_id"]])) and r["n_docs"] == len(have[r["class_id"]])


def test_dealt_bands_lose_no_link(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(t for seed in range(401, 405) for t in _variants(seed, 40))]
    # One line of each pair starts alike: a band of lines that are not near to each other.
    rows += [(1000 + i, "the same five words begin " + words(500 + i, 12)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda: sorted((r["id"], r["start"], r["n"], r["n_docs"], r["removed"]) for r in passages.repeated(df).collect())
    whole = of()
    monkeypatch.setattr(near, "DEALT_MEMBERS", 4)
    assert whole and of() == whole


def test_near_lines_with_twelve_words_link(spark):
    lead, short = words(601, 19), words(602, 12)
    df = spark.createDataFrame([(1, lead + "\n" + short), (2, lead + "\n" + short + " more")], "doc_id long, text string")
    got = [r for r in passages.repeated(df).collect() if r["n"] in (12, 13)]
    assert {(r["id"], r["n"], r["removed"]) for r in got} >= {(1, 12, False), (2, 13, True)} and {r["n_docs"] for r in got} == {2}


def test_like_lines_of_one_document_stay(spark):
    line = words(611, 30)
    df = spark.createDataFrame([(1, line + "\n" + words(612, 30) + "\n" + line + " more"), (2, words(613, 40))], "doc_id long, text string")
    assert passages.repeated(df).count() == 0


def test_words_are_the_same_however_texts_are_cut(monkeypatch):
    texts = [None, "", words(621, 3000) + "\n x", " ", "\n\n", "ÄÖ ü😀x it's, _under_ " + "long" * 4000, words(622, 50)]
    whole = near.words_of(texts)
    monkeypatch.setattr(near, "CHUNK", 300)
    cut = near.words_of(texts)
    assert all((a == b).all() for a, b in zip(whole[:4], cut[:4])) and (near.firsts(whole[4]) == near.firsts(cut[4])).all()
    of, start, end, h, _ = whole
    for i, t in enumerate(texts):
        assert [t[a:b] for a, b in zip(start[of == i], end[of == i])] == (t or "").split()
    same = near.words_of(["It's HERE, now.", "its here now"])[3]
    assert (same[:3] == same[3:]).all() and len(set(same[:3].tolist())) == 3


def test_edges(spark):
    line = words(631, 40)
    rows = [(None, line), (2, line), (2, line), (3, None), (4, ""), (5, line + " " + "😀 " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "h": F.lit("x"), "class_id": F.lit(None).cast("string")})
    got = passages.repeated(df)
    assert {(r["id"], r["removed"]) for r in got.filter("n = 40").collect()} == {(None, False), (2, True)}
    left = passages.without(df, got)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 2, 3, 4, 5]
    empty = df.limit(0)
    assert passages.without(empty, passages.repeated(empty)).count() == 0


def test_a_written_table_leaves_no_setting_and_can_be_written_from_again(spark):
    before = spark.conf.get(FILE_CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    first, second = materialize(df, "t"), materialize(df.join(df.withColumnRenamed("n", "m"), "k"), "t")
    assert first.count() == second.count() == df.count() == 10
    assert spark.conf.get(FILE_CLEANUP, None) == before
