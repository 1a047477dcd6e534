"""Line numbers, resumable output, rules, pairs, choices and reports on rows made by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.functions import serving as S
from millrace.operators import merge as M
from millrace.operators import plan as P
from millrace.operators import report as R
from millrace.operators import rules as O
from millrace.operators import validate as V
from millrace.sources import lines as L
from millrace.sources import readers, writers


def record(text, **more):
    return json.dumps({"messages": [{"role": "system", "content": ""}, {"role": "user", "content": text}], **more}, ensure_ascii=False)


@pytest.fixture
def splits(spark):
    """Files are cut into splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_numbered_lines(spark, tmp_path, splits):
    want, place = [], 0
    for name, count in (("a.jsonl", 90), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 57)):
        rows = [f"{name} {i} " + "x" * (i * 7 % 60) if i % 9 else "" for i in range(count)]
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
        want += [(name, i + 1, place + i + 1, r) for i, r in enumerate(rows)]
        place += count
    got = L.numbered_lines(spark, f"{tmp_path}/*.jsonl")
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r["_file"].rsplit("/", 1)[1], r["_line"], r["_place"], r["value"]) for r in got.collect()) == want


def test_first_wins_by_line(spark, tmp_path, splits, monkeypatch):
    rng = random.Random(4)
    words, seen, want = [f"做 {k}" for k in range(30)], set(), []
    for tag in ("one", "two"):
        for part in range(3):
            rows = [rng.choice(words) for _ in range(40)]
            (tmp_path / f"{tag}.shard{part}.jsonl").write_text("".join(("\n" if i % 7 == 3 else "") + record(" " * (i % 3) + r, _source_key=f"{tag}{part}-{i}") + "\n" for i, r in enumerate(rows)))
            for i, r in enumerate(rows):
                if r not in seen:
                    seen.add(r)
                    want.append(f"{tag}{part}-{i}")
    sources = [("gone", f"{tmp_path}/no.jsonl"), ("one", f"{tmp_path}/one.shard*.jsonl"), ("two", f"{tmp_path}/two.shard*.jsonl")]
    for most in (L.MOST_SPLITS, 2):
        monkeypatch.setattr(L, "MOST_SPLITS", most)
        rows = L.multi_source_lines(spark, sources).withColumn("key", F.trim(F.col("messages")[1]["content"]))
        kept = M.first_of_each(rows, ["key"], ["_rank", "_place"], keep=["_source_key"])
        assert sorted(r[0] for r in kept.collect()) == sorted(want)
    (tmp_path / "two.shard1.jsonl").write_text("{cut\n" + record("new") + "\n")
    assert L.multi_source_lines(spark, sources, strict=False).filter("_file like '%two.shard1%'").select("_line").collect()[0][0] == 2
    with pytest.raises(Exception, match="no JSON in line 1"):
        L.multi_source_lines(spark, sources).select("_line", "messages").collect()
    assert L.multi_source_lines(spark, sources[:1]).count() == 0


def test_quality(spark, tmp_path):
    page = "<!DOCTYPE html> viewport </HTML>"
    rows = [record(page), "{", "", record("x viewport"), '{"messages": []}', "[", "{}", "nope", '{"messages": [{"role": "user"}]}']
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    got = L.judged(L.numbered_lines(spark, str(tmp_path / "a.jsonl")))
    assert L.quality_counts(got, []).first().asDict() == {"total": 8, "valid_json": 5, "valid_html": 1, "shortest": 10, "longest": 32, "mean": 21}
    first = [r["sample"] for r in L.first_samples(got, ["_file"], "_line").orderBy("rank").collect()]
    assert first == ["行2: JSON 解析失败", "行4: HTML 缺少 ['DOCTYPE', '</html>'] (长度=10)", "行5: 缺少 messages[-1].content"]
    assert [r["sample"] for r in L.first_samples(got, ["reason"], "_line", 2).filter("reason = 'content'").orderBy("rank").collect()] == ["行5: 缺少 messages[-1].content", "行7: 缺少 messages[-1].content"]


def test_append_goes_on(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(str(i), i) for i in range(20)] + [(None, 99)], "key string, n int").repartition(4)
    read = lambda: sorted((r["key"] or "", r["n"], r["_run"]) for r in spark.read.schema("key string, n int, _run string").json(path).collect())
    writers.append_new(df.filter("n < 10"), path, "key", "a")
    first = read()
    writers.append_new(df.filter("n < 10"), path, "key", "a")
    assert read() == first and len(first) == 10
    # A run that is cut off leaves nothing that counts; repeated, it is whole.
    cut = df.withColumn("n", F.when(F.col("n") == 15, F.raise_error(F.lit("cut off"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="cut off"):
        writers.append_new(cut, path, "key", "b")
    assert read() == first
    writers.append_new(df, path, "key", "b")
    whole = read()
    assert [r for r in whole if r[2] == "a"] == first and sorted(r[1] for r in whole) == sorted([*range(20), 99])
    writers.append_new(df, path, "key", "b")
    writers.append_new(df, path, "key", "c")
    assert read() == whole


def test_permuted_write_reads_back_in_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc"), F.lit("x").alias("_r"))
    placed = M.permuted(df.repartition(7), "doc").select("doc", "position")
    by_place = [r["doc"] for r in placed.orderBy("position").collect()]
    assert sorted(by_place) == list(range(500)) and by_place != sorted(by_place)
    assert [r["position"] for r in placed.orderBy("position").collect()] == list(range(500))
    assert by_place != [r["doc"] for r in M.permuted(df, "doc", seed="43").orderBy("position").collect()]
    writers.shards(placed, str(tmp_path / "out"), ["position"], files=5)
    back = L.numbered_lines(spark, str(tmp_path / "out" / "*.json")).orderBy("_place").collect()
    assert [json.loads(r["value"])["doc"] for r in back] == by_place


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, "a"), ("k", "a"), (None, None), ("m", None)], "key string, cat string")
    assert sorted(str(r["key"]) for r in M.stratified_split(df, "key", "cat").collect()) == ["None", "k", "m"]
    assert M.isolated_split(df, "cat", "key", ["z"], []).count() == 4
    assert M.permuted(df, "key").count() == 4
    assert [r["position"] for r in M.permuted(df, "key").orderBy("position").collect()] == [0, 1, 2, 3]


def test_keys_do_not_run_together(spark):
    rows = [("a\x1f=b", "c"), ("a", "b\x1f=c"), ("-", None), (None, "-"), (None, None), ("", "")]
    assert M.first_of_each(spark.createDataFrame(rows, "x string, y string").withColumn("o", F.monotonically_increasing_id()), ["x", "y"], ["o"]).count() == len(rows)


def test_null_pages_are_empty_ones(spark):
    df = spark.createDataFrame([(0, None), (1, "")], "i int, html string")
    a, b = V.validate(df).withColumns({"g": V.gate(), "t": V.triad(), "s": V.accept_strict(), "l": V.accept_loose()}).orderBy("i").drop("i", "html").collect()
    assert a == b and a["total_score"] == 0 and not a["passed"] and a["g"] != "OK" and a["t"] == ["DOCTYPE", "</html>", "viewport"] and a["s"] is False


def test_choices_in_rows_and_arrays_agree(spark):
    rng = random.Random(9)
    rows = [(g if g else None, k, rng.choice([None, 10, 39, 40, 70, 80, 95]), rng.choice(["sample", "sample", "greedy", None])) for g in range(60) for k in range(rng.randint(1, 5))]
    rows += [(100, 0, 30, "greedy"), (101, 0, None, "sample")]
    df = spark.createDataFrame(rows, "g int, attempt int, score int, mode string")
    for stop, floor, ties in ((80, 40, False), (None, 40, True), (60, 90, True)):
        one = {r["g"]: (r["score"], r["attempt"], r["fallback"]) for r in R.best_of_n(df, "g", "attempt", "score", "mode", stop, floor, ties).collect()}
        arrays = df.groupBy("g").agg(F.collect_list(F.struct("attempt", "score", "mode")).alias("a"))
        two = {r["g"]: (r["b"]["score"], r["b"]["attempt"], r["b"]["fallback"]) for r in arrays.select("g", R.best_in_array("a", stop, floor, ties).alias("b")).collect() if r["b"]}
        want = {}
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1])
            drawn, greedy = [r for r in own if r[3] != "greedy"], [r for r in own if r[3] == "greedy"]
            upto = next((i for i, r in enumerate(drawn) if stop is not None and r[2] >= stop), len(drawn))
            best = max(drawn[: upto + 1], key=lambda r: (r[2], -r[1]), default=None)
            other = max(greedy, key=lambda r: (r[2], -r[1]), default=None)
            fall = other is not None and (best is None or (best[2] < floor and (other[2] >= best[2] if ties else other[2] > best[2])))
            if best or other:
                want[g] = ((other if fall else best)[2], (other if fall else best)[1], fall)
        assert one == want and two == want


def test_rules(spark):
    rules = O.rule_table(spark, S.SUFFIX_RULES, ["pattern", "suffix"])
    raw = ["倒计时", "番茄钟倒计时", "番茄钟，25分钟倒计时", "  x  ", "", "y" * 20, "计算器" + "z" * 30, "打字速", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, t string")
    got = [r["e"] for r in df.select("i", O.serve_enhanced("t", rules, S.GENERIC_SUFFIX).alias("e")).orderBy("i").collect()]
    assert got[0] == "倒计时" + S.SUFFIX_RULES[1][1] and got[1] == "番茄钟倒计时" + S.SUFFIX_RULES[0][1]
    assert got[2] == "番茄钟，25分钟倒计时" + S.SUFFIX_RULES[1][1]
    assert got[3] == "x" + S.GENERIC_SUFFIX and got[4] == S.GENERIC_SUFFIX and got[5] == raw[5] and got[6] == raw[6] and got[7] == "打字速" + S.SUFFIX_RULES[27][1] and got[8] is None
    assert len(S.TEMPLATE_WORDS) == 46 and len(S.SUFFIX_RULES) == 49
    with pytest.raises(ValueError):
        O.first_rule(rules, lambda r: F.lit(True), "suffix", most=3)
    words = O.rule_table(spark, [("a", "seed a"), ("b", "seed b"), ("imi", "seed c")], ["word", "target"])
    seeds = spark.createDataFrame([("seed b", "old", 1), ("seed b", "page b", 2), ("plain", "page p", 3), ("seed c", None, 4)], "instruction string, html string, place int")
    asked = spark.createDataFrame([(0, "a and b"), (1, "plain"), (2, "other"), (3, "a"), (4, None), (5, "IMI")], "i int, q string")
    got = [(r["template"], r["origin"]) for r in O.serve_template(asked, "q", words, seeds).orderBy("i").collect()]
    # "plain" holds the word a, whose target is no seed.
    assert got == [("page b", "golden_template"), ("page p", "golden_template"), (None, "model"), (None, "model"), (None, "model"), (None, "golden_template")]


def test_pairs_and_complete_sets(spark):
    one = spark.createDataFrame([("a", 3), ("b", 4), (None, 9)], "tag string, v int")
    two = spark.createDataFrame([("a", 5), ("c", 1), (None, 2)], "tag string, v int")
    expected = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "tag string")
    got = {r["tag"]: tuple(r)[1:] for r in R.paired(expected, one, two, "tag", "v").collect()}
    assert got == {
        "a": (3, 5, False, False, True, 2), "b": (4, 0, False, True, False, -4), "c": (0, 1, True, False, False, 1), "z": (0, 0, True, True, True, 0), None: (9, 2, False, False, True, -7),
    }
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (2, "w"), (3, "y"), (None, "x")], "item int, v string")
    assert sorted(map(tuple, R.complete_only(rows, "item", "v", ["x", "y"]).collect())) == [(1, "x"), (1, "y"), (1, "y")]


def test_split_summary(spark):
    rows = [("h1", "train", "A", "L1")] * 3 + [("h1", "val", "A", "L1"), ("h2", "test", "B", None), ("h3", "train", None, "L2"), ("h4", "val", "B", "L1")]
    got = R.split_summary(spark.createDataFrame(rows, "h string, s string, c string, l string"), "h", "s", "c", "l").first().asDict()
    assert got["total"] == 7 and got["total_groups"] == 4 and got["sizes"] == {"test": 1, "train": 4, "val": 2} and got["groups"] == {"test": 1, "train": 2, "val": 2}
    assert got["leaked"] == {"test": 0, "train": 0, "val": 1} and got["categories"] == {"train": {"A": 3, "": 1}, "val": {"A": 1, "B": 1}, "test": {"B": 1}}
    assert got["levels"] == {"L1": 5, "": 1, "L2": 1} and got["ratios"]["train"] == "57.1%"
    empty = R.split_summary(spark.createDataFrame([], "h string, s string, c string, l string"), "h", "s", "c", "l").first().asDict()
    assert empty["total"] == 0 and empty["sizes"] == {} and empty["levels"] == {}


def test_spans_cut_out_the_replies(spark):
    talk = [("system", "s"), ("user", "做"), ("assistant", "one 余额"), (None, "odd"), ("assistant", None), ("user", "q"), ("assistant", "🙂 end")]
    df = spark.createDataFrame([(1, talk), (2, []), (3, talk[:2])], "i int, messages array<struct<role: string, content: string>>")
    got = {r["i"]: ([r["text"][s["start"] : s["end"]] for s in r["spans"]]) for r in df.select("i", readers.render_chat().alias("text"), readers.reply_spans().alias("spans")).collect()}
    assert got == {1: [(c or "") + readers.END for role, c in talk if role == "assistant"], 2: [], 3: []}


def test_shards_are_dealt_in_order(spark):
    df = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (None,)], "n int").repartition(5)
    got = [sorted(r["n"] if r["n"] is not None else 99 for r in P.shard(df, "n", 4, k).collect()) for k in range(4)]
    assert [x for x in got[1] if x < 99] == list(range(1, 40, 4)) and sum(map(len, got)) == 42
    assert P.shard(df.limit(0), "n", 4, 1).count() == 0


def test_evolutions_and_progress(spark):
    got = sorted(r["_source_key"] for r in P.evolution_list(spark.createDataFrame([(7,)], "i int"), "i", ["depth", "mix"]).collect())
    assert got == ["base_7", "evol_7_depth", "evol_7_mix"]
    e = spark.createDataFrame([(True, 2.0), (False, 3.0), (None, 5.0)], "ok boolean, s double")
    assert tuple(P.progress(e, F.col("ok"), F.sum("s"), 9).first()) == (1, 2, 0.3, 20.0)
    assert tuple(P.progress(e.limit(0), F.col("ok"), F.sum("s"), 9).first()) == (0, 0, 0.0, 0.0)


def test_config():
    c = Config.read(["--max-len", "2048", "--data-dir", "d"], {"MILLRACE_SEED": "7", "MILLRACE_MAX_LEN": "1", "MILLRACE_NUM_SHARDS": "3"})
    assert c == Config("d", 2048, 3, 0, "7") and Config.read([], {}) == Config()
    for args, env in ((["--shard-index", "3"], {}), ([], {"MILLRACE_MAX_LEN": "0"}), ([], {"MILLRACE_TEST_SHARE": "x"}), ([], {"MILLRACE_VAL_SHARE": "1"})):
        with pytest.raises(ValueError):
            Config.read(args, env)
