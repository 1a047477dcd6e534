import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, packing
from millrace.llm.common import documents

SF = "/root/testdata/sf0.001"
PATH = bpe.default_tokenizer()
ODD = ["", None, "a", "  x  \n\n y\t", "<|endoftext|>", "a  <|endoftext|>  b##<|endoftext|>", "naïve Ünïcode 变量 😀 x²½", "x" * 5000, "it's we'll 'S", "\x1c\x85 \xa0a", "٣٤ 5६", "a b ​"]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [(e, t.decode(e, skip_special_tokens=False)) for e in (x.ids for x in t.encode_batch(texts, add_special_tokens=False))]


def with_odd(spark, docs):
    odd = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(ODD)], docs.schema)
    null_id = spark.createDataFrame([(None, "null id text", None, None, None), (7, "again", None, None, None), (7, "again", None, None, None)], docs.schema)
    return docs.unionByName(odd).unionByName(null_id)


def test_encode_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD_WORDS", 200)
    docs = with_odd(spark, documents(spark, SF)).withColumn("word", F.lit(1)).withColumn("key", F.lit(2))

    def finish(ids):
        import pyarrow as pa

        return [pa.array(ids, pa.binary())]

    got = sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in bpe.encode_documents(docs, PATH, finish, "ids binary").collect())
    rows = docs.collect()
    want = sorted((r["doc_id"] or -1, np.array(e, "<u4").tobytes()) for r, (e, _) in zip(rows, reference([r["text"] or "" for r in rows])))
    assert got == want


def test_query(spark):
    rows = documents(spark, SF).collect()
    want = {
        (r["doc_id"], len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
        for r, (e, d) in zip(rows, reference([r["text"] for r in rows]))
    }
    assert {tuple(r) for r in bpe.op9_bpe(spark, SF).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'as1<|>é"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_local_encoder(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == reference([text])[0][0]


def test_encoder_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "_cache", {})
    text = " ".join(f"word{i} é{i}<|endoftext|>" for i in range(100))
    encode = packing.encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == reference([text])[0][0]
    assert len(packing._cache[PATH]) <= 20


def test_bytes_of_few_ids_cost_little():
    """A new word has few ids: an Arrow array for each cost more than the merging (13 microseconds a word)."""
    lists = [[i, 7, 50000][: i % 4] for i in range(20000)]
    begin = time.process_time()
    got = [bpe._ids_bytes(x) for x in lists]
    assert time.process_time() - begin < 4e-6 * len(lists)
    assert got == [np.array(x, "<u4").tobytes() for x in lists]



def test_runs(monkeypatch):
    monkeypatch.setattr(bpe, "RUN_CHARS", 10)
    text = "ab  cd ef, \n gh ij  kl mnopqrstuvwxyz " * 5
    s = bpe.vocabulary(PATH).splitter
    runs = list(s.runs(text))
    assert len(runs) > 3 and [w for r in runs for w in r] == s._plain(text)


def test_shortest_pack_first():
    rng = np.random.default_rng(1)
    hist = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 900, 300))}
    patterns = packing.shortest_pack_first(hist)
    seen = {}
    for n, p in patterns:
        assert n > 0 and sum(p) <= 2048
        for x in p:
            seen[x] = seen.get(x, 0) + n
    assert seen == hist


def test_packing(spark):
    docs = with_odd(spark, documents(spark, SF))
    got = packing.pack_documents(docs.filter("doc_id is null or doc_id <> 7")).collect()
    rows = [r for r in docs.collect() if r["doc_id"] != 7]
    ids = {r["doc_id"]: [*e, 1] for r, (e, _) in zip(rows, reference([r["text"] or "" for r in rows]))}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            part = ids[d][at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(by_seq)) > 0.9


def test_empty(spark):
    docs = documents(spark, SF).limit(0)
    assert packing.pack_documents(docs).count() == 0


def test_packing_takes_any_id_and_repeated_rows(spark):
    rows = [("a", "one two three")] * 700 + [(None, None)] * 20 + [("b", "x " * 5000)]
    df = spark.createDataFrame(rows, "name string, body string").withColumn("length", F.lit(1))
    got = packing.pack(packing.pieces(df, PATH, doc_id="name", text="body"))
    rows = got.collect()
    assert sum(r["length"] for r in rows if r["name"] == "b") == next(r["doc_tokens"] for r in rows if r["name"] == "b")
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= packing.SEQUENCE


def test_bpe_empty_table(spark):
    assert bpe.encode_documents(documents(spark, SF).limit(0), PATH, lambda ids: [pa.array([len(x) for x in ids], pa.int64())], "n long").count() == 0


def test_documents_of_one_hash_are_encoded_all_the_same(spark, monkeypatch):
    texts = ["alpha beta qqzx", "gamma wwyk rrtp", "qqzx only", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(bpe.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df, PATH, lambda ids: [pa.array(ids, pa.binary())], "ids binary").collect()}
    assert [np.frombuffer(got[i], "<u4").tolist() for i in range(5)] == [e for e, _ in reference([t or "" for t in texts])]
