import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import langid, media
from millrace.llm.common import documents

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip(data):
    payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
    fps, frames = media.read_avi(media.write_avi(media.encode_frames(payload)))
    assert fps == media.FPS and media.decode_frames(frames).tobytes() == payload
    p = media._parse(frames[0])
    scan = frames[0][p["scan"] : -2].replace(b"\xff\x00", b"\xff")
    assert (media._slow_differences(scan, p["table"], 576) == _differences(payload[:576])).all()


def _differences(frame):
    x = np.frombuffer(frame, np.uint8).reshape(24, 24).astype(int)
    left = np.hstack([np.concatenate([[128], x[:-1, 0]])[:, None], x[:, :-1]])
    return (x - left).ravel()


def test_shots():
    still = np.zeros((5, 24, 24), np.uint8)
    assert media.shots(np.concatenate([still, still + 100, still + 7])) == [(0, 5), (5, 10), (10, 15)]


def test_media_query(spark):
    rows = {r["doc_id"]: r["text"].encode() for r in documents(spark, SF).collect()}
    for r in media.op4_media(spark, SF).collect():
        raw = rows[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "é" * 288, 3), (2, "é" * 288, 3)], "doc_id long, text string, media int")
    got = media.read(media.store(odd)).select("n_bytes", F.length("payload").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(0, 576), (0, 576), (576, 576), (576, 576)]
    assert media.clip_rows(odd.limit(0)).count() == 0


def test_field_matches_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    e, t = np.exp(rng.normal(size=(1, 4, 3))), rng.normal(size=(3, 3))
    got = langid.marginals(e, np.ones((1, 4), bool), t)[0]
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        s = np.prod([e[0, i, y[i]] for i in range(4)]) * np.exp(sum(t[a, b] for a, b in zip(y, y[1:])))
        for i in range(4):
            want[i, y[i]] += s
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_language(spark):
    got = {r["doc_id"]: r for r in langid.op2_language(spark, SF).collect()}
    docs = documents(spark, SF).collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert all(got[d["doc_id"]]["held_out"] for d in held)
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right >= 0.9 * len(held)


def test_language_edges(spark):
    field = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)
    odd = spark.createDataFrame([(None, None, "x"), (1, " 12 ²³ ", "y"), (2, "the cat", "z"), (2, "the cat", "z"), (3, "x " * 5000, "q")], "doc_id long, text string, `a b` string")
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in langid.identify(odd, field).collect())
    assert got[:4] == [(0, "und"), (1, "und"), (2, "en"), (2, "en")]
    assert [r["lang_pred"] for r in langid.identify(odd, langid.fit([])).collect()] == ["und"] * 5
    seg = langid.segments("the cat and the dog le chat et le chien", field)
    assert [s[2] for s in seg] == ["en", "fr"]
    assert langid.training_rows(documents(spark, SF).limit(0)) == []


def _rows(spark):
    return langid.training_rows(documents(spark, SF))


def test_chains_do_not_part_a_text(spark, monkeypatch):
    field = langid.fit(_rows(spark))
    words = [langid.words_of(r["text"]) for r in documents(spark, SF).limit(20).collect()]

    def of(label):
        p, own, doc = label(words)
        return [p[doc == d][own[doc == d]] for d in range(len(words))]

    cut = of(langid.Labeller(field))
    monkeypatch.setattr(langid, "CHAIN", 1 << 15)
    whole = of(langid.Labeller(field))
    assert all(len(a) == len(b) == len(w) and np.abs(a - b).max(initial=0) < 0.02 for a, b, w in zip(cut, whole, words))


def test_fit_is_the_same_each_time_and_learns_moves(spark):
    rows = _rows(spark)
    assert rows == _rows(spark)
    field = langid.fit(rows)
    k = len(field.labels)
    assert np.isfinite(field.transitions).all() and (np.diag(field.transitions) > field.transitions[~np.eye(k, dtype=bool)].max()).all()


def test_query_against_forward_backward_of_each_text(spark, monkeypatch):
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    field = langid.fit(langid.training_rows(docs))
    got = {r["doc_id"]: r for r in langid.op2_language(spark, SF).collect()}
    for r in docs.collect():
        words = langid.words_of(r["text"])
        if not words:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        e = field.emissions(words)[None].astype(np.float32)
        total = langid.marginals(e, np.ones((1, len(words)), bool), field.transitions)[0].sum(0)
        assert got[r["doc_id"]]["lang_pred"] == field.labels[int(total.argmax())] or np.sort(total)[-1] - np.sort(total)[-2] < 0.02 * len(words)
        assert abs(got[r["doc_id"]]["score"] - total.max() / total.sum()) < 0.02
    assert langid.identify(docs.limit(0), field).count() == 0


def test_reader_takes_the_first_video_stream():
    import struct

    one = media.write_avi(media.encode_frames(b"abc" + b"\xff" * (2 * media.FRAME - 3)))
    fps, frames = media.read_avi(one)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    audio = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + b"\0" * 16 + struct.pack("<II", 1, 44100) + b"\0" * 28) + chunk(b"strf", b"\1" * 17))
    video = one[one.index(b"LIST", one.index(b"avih")) : one.index(b"LIST", one.index(b"strf"))]
    other = video.replace(struct.pack("<I", media.FPS), struct.pack("<I", 99))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", b"\0" * 56) + audio + video + other)
    movi, index, at = [], [], 4
    for name, data in [(b"00wb", b"sound")] + [x for f in frames for x in ((b"01dc", f), (b"02dc", b"other"), (b"00wb", b"more"))]:
        movi.append(chunk(name, data))
        index.append(struct.pack("<4sIII", name, 16, at, len(data)))
        at += len(movi[-1])
    file = chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))
    assert media.read_avi(file) == (fps, frames) == (media.FPS, frames)
