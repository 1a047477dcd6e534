import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import idstore as I
from millrace.llm.bpe import default_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for r in docs:
        ids = library(r["text"])
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = I.op12_id_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_edges_and_keyed_access(spark, library):
    texts = ["", None, "a <|endoftext|> b", "x " * 60000, " \n\t ", "ABC 余额 é", "same", "same"]
    rows = [(10 * i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "none", None, 1), (None, "none at all", "", 1), (-5, "below", "", 1)]
    # One id that holds half of the rows: it spans shards.
    rows += [(35, f"copy number {i}", "", 1) for i in range(40)] + [(35, "copy number 3", "", 1)] + [(1000 + i, f"word {i}", "", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string, shard int").repartition(3)
    written = I.write(df, default_tokenizer(), shard_docs=8)
    I.index(written, part_keys=16)
    catalog = written.catalog.collect()
    assert len(catalog) == len(rows) and len({r["shard"] for r in catalog if r["doc_id"] == 35}) > 2
    assert sorted(r["ordinal"] for r in catalog if r["doc_id"] == 35) == list(range(41))
    assert sorted(r["ordinal"] for r in catalog if r["doc_id"] is None) == [0, 1]
    found = I.read(I.lookup(written.catalog, written.uri), written.uri, lambda p: [__import__("pyarrow").array([x.tolist() for x in p])], "ids array<long>").orderBy("start").collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in found)) == sorted((d is not None, d or 0, library(t)) for d, t, *_ in rows)
    # In ascending order of id, nulls first, without gaps.
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n"] for r in found[:-1])]).tolist()
    store = I.Store(written.uri)
    for d, t, *_ in rows:
        if d != 35 and d is not None:
            assert store.get(d).tolist() == library(t)
    assert sorted(store.get(35, i).tolist() for i in range(41)) == sorted(library(t) for d, t, *_ in rows if d == 35)
    assert sorted(store.get(None, i).tolist() for i in (0, 1)) == sorted(library(t) for d, t, *_ in rows if d is None)
    assert all(store.get(d, o) is None for d in range(5000, 5200) for o in (0, 1)) and store.get(35, 41) is None and store.get(None, 2) is None
    absent = spark.range(9000, 9500).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"))
    assert I.lookup(absent, written.uri).count() == 0


def test_empty(spark):
    written = I.write(spark.createDataFrame([], "doc_id long, text string"), default_tokenizer())
    I.index(written)
    assert I.read(I.lookup(written.catalog, written.uri), written.uri, I._crc, "ids_crc32 long").collect() == []
    assert I.Store(written.uri).get(1) is None


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20000])
def test_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    p = I.Perfect.build(h1, h2)
    q, size = I.Perfect.load(p.dump() + b"more")
    assert size == len(p.dump())
    for x in (p, q):
        assert sorted(x.slots(h1, h2).tolist()) == list(range(n))


def test_equal_first_hashes_are_told_apart():
    h1 = np.zeros(50, np.uint64)
    h2 = np.arange(50, dtype=np.uint64) * np.uint64(2)
    assert sorted(I.Perfect.build(h1, h2).slots(h1, h2).tolist()) == list(range(50))


def test_hashes_match(spark):
    keys = [(1, 0), (-7, 3), (None, 2), (2**60, 1)]
    df = spark.createDataFrame(keys, "doc_id long, ordinal long")
    got = df.select(*I.key_hashes(F.col("doc_id"), F.col("ordinal"))).collect()
    assert [tuple(x % 2**64 for x in r) for r in got] == [I.python_hashes(*k) for k in keys]
