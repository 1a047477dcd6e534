import glob
import os
import re

import duckdb
import numpy as np
import pytest

from millrace.llm import phrases as P
from millrace.llm.common import documents
from millrace.llm.queries import ORACLE_SQL

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(rows, least, top):
    """By counting every phrase and comparing every pair of one and a longer one."""
    f, total = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            if w:
                total[lang] = total.get(lang, 0) + len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        key = (lang, tuple(w[i : i + k]))
                        f[key] = f.get(key, 0) + 1
    out = []
    kept = {k: a for k, a in f.items() if a >= least}
    for (lang, w), a in kept.items():
        if len(w) < 2:
            continue
        longer = [b for (x, v), b in kept.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    got = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        got += [(lang, i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(got)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "w1") for r in rows], "text string, lang string, phrase string").repartition(3)
    return sorted(tuple(r) for r in P.collocations(df, **kw).select(*NAMES).collect())


def test_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["a", "b", "The", "é", "\x85", "c\xa0d", "zz", "\x1c", "x"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(60)), ["en", None, "und", "f r", ""][i % 5]) for i in range(60)]
    rows += [(None, "en"), ("", "en"), (" \t. ", "none"), ("A B. C", None), rows[0], rows[0], ("a b the " * 3000, "en"), ("a b the x " * 40, "de")]
    monkeypatch.setattr(P, "SHARD_BYTES", 2000)
    for least, top in ((3, 2000), (30, 4), (200, 10)):
        want = slow(rows, least, top)
        assert run(spark, rows, least=least, top=top, bits=16) == want
    # Counters that meet change nothing.
    assert run(spark, rows, least=3, bits=16) == slow(rows, 3, 2000)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("one two", "en")]) == []


def test_counters_never_lose(spark):
    rows = [("p q " * 40 + f"only{i}", "en") for i in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    bits = P.counters(df, 18)
    shard = P.Shard([(0, rows[0][0].encode())], ["en"])
    (_, one), (pair, two) = shard.paths(18)[:2]
    on = lambda at: bits[at >> 3] >> (7 - (at & 7)) & 1
    held = [w for w, c in zip(shard.words, range(len(shard.words))) if w[:1] != b"\xff" and on(one[shard.code == c][0])]
    assert held == [b"p", b"q"] and on(two[pair][0])


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9 * 10**17, 10**18, 9 * 10**17)], "a long, l long, r long")
    assert df.select(P._score("a", F.col("l"), F.col("r"))).first()[0] == 2_000_000 * 9 * 10**17 // (19 * 10**17)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"/root/testdata/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = P.collocations(documents(spark, f"/root/testdata/{sf}")).select(*NAMES).collect()
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op13_phrases']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 50
