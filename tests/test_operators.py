"""Branches that the standard tables do not reach, on rows made by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.functions import text as T
from millrace.operators import merge as M
from millrace.operators import plan as P
from millrace.operators import report as R
from millrace.operators import validate as V

PAGE = (
    "<!DOCTYPE html><html lang=\"zh\"><head><meta charset=\"utf-8\"><meta name=\"viewport\" content=\"width=device-width\"><title>x</title><style>.card{max-width:400px;padding:12px;border-radius:16px;box-shadow:0 0 1px #fff;"
    "background:linear-gradient(#123456,#abcdef)}</style></head><body><button onclick=\"go()\">计时器工具</button><script>let a=1;function go(){if(a>0){document.getElementById('x').textContent=a;}}"
    "document.addEventListener('click',()=>{go()})</script></body></html>"
)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda p: "\n  " + p + "\n", "OK"), (lambda p: "x" + p, "不以<!DOCTYPE html>开头"), (lambda p: p + "x", "缺少</html>闭合标签"), (lambda p: p.replace("viewport", "v"), "缺少viewport meta标签"),
        (lambda p: "<!doctype html>viewport</html>", "代码过短(30字符，最低200)"), (lambda p: p.replace("let a", "a" * 10000), "代码过长"), (lambda p: p.replace("<title", "cdn.x unpkg.com<title"), "引用了外部CDN: cdn\\."),
        (lambda p: p.replace("<style", "<tyle"), "缺少<style>内联CSS标签"), (lambda p: p.replace("<script", "<cript"), "缺少<script>内联JS标签"), (lambda p: p.replace("<body", "<ody"), "缺少<head>或<body>标签"),
    ],
)
def test_gate(spark, change, reason):
    assert one(spark, V.gate(), html=change(PAGE)).startswith(reason)


def test_layers_and_structure(spark):
    pages = [PAGE, PAGE + "<!doctype html>", PAGE.replace("padding:12px", "padding:9px").replace("radius:16px", "radius:4px"), PAGE.replace("padding:12px", "padding : 99999999999999999999px"), "no page", ""]
    rows = V.validate(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")).orderBy("i").collect()
    assert (rows[0]["mobile"], rows[0]["visual"], rows[0]["logic"]) == (25, 25, 20) and rows[0]["passed"]
    assert rows[1]["mobile"] is None and rows[1]["total_score"] == 0 and rows[1]["all_issues"] == ["输出了多个HTML文件"]
    assert (rows[2]["mobile"], rows[2]["visual"]) == (20, 22) and "按钮padding偏小(9px)" in rows[2]["all_issues"]
    assert rows[3]["mobile"] == 25 and len(rows[4]["all_issues"]) == 6 and not rows[5]["passed"]


def test_scores(spark):
    df = spark.createDataFrame([(PAGE,), (PAGE.replace("</script>", "").replace("</body></html>", ""),), ("",)], "html string")
    a, b, c = H.score_100(df, [("go", ["go\\("]), ("plus", ["+"]), ("none", ["zzz("])]).select("J", "I", "total", "c_css").collect()
    assert (a["J"]["events"], a["J"]["state"], a["I"]["score"], a["I"]["hits"]) == (2, 1, 8, ["go"]) and c["total"] == 5 and b["J"]["events"] == 0
    d = H.detailed(df, [("a", ["BUTTON"])], ["计时器"]).select("j_js", "truncated", "i_instruction", "max_depth", "js_functions").collect()
    assert d[0]["max_depth"] == 3 and not d[0]["truncated"] and d[1]["truncated"] and d[1]["js_functions"] == d[0]["js_functions"] and d[0]["i_instruction"] == 5
    s = df.select(H.six_points().alias("six"), H.five_checks().alias("five"), H.ten_points(low=F.lower("html")).alias("ten")).collect()
    assert (s[0]["six"], s[0]["five"]) == (6, 5) and s[0]["ten"]["style"] == 2 and s[0]["ten"]["script"] == 1 and s[2]["six"] == 1


def test_cleaning(spark):
    assert one(spark, H.clean_code("h"), h="```html\nsome talk <!DOCTYPE html><p></HTML> rest\n```\n") == "<!DOCTYPE html><p></HTML>"
    assert one(spark, H.strip_fence("h"), h="```\nabc\n```") == "abc" and one(spark, H.escape("h"), h="<a b='\"'>&") == "&lt;a b=&#x27;&quot;&#x27;&gt;&amp;"
    assert one(spark, T.normalized("h"), h="\n ABC,帮我做个计算器 ") == "abc计算器"
    assert one(spark, T.code_hash("h"), h="A  b C\n") == one(spark, F.md5(F.lit("abc")), h="")
    assert [one(spark, H.delta_text(F.col("d")), d=x) for x in (3, 0, -2)] == ["+3", "+-0", "-2"]


def test_merge(spark):
    a = spark.createDataFrame([(1, "x ", "s")], "i int, t string, _style string")
    b = spark.createDataFrame([(2, "X"), (3, "x")], "i int, t string")
    u = M.union_sources([("a", a), ("b", b)])
    assert [r["i"] for r in M.first_of_each(u, [T.strip("t")], ["_rank", "i"]).orderBy("i").collect()] == [1, 2]
    assert [r["i"] for r in M.first_of_each(u, [M.composite_key("t", "_style")], ["_rank", "i"]).orderBy("i").collect()] == [1, 2]
    assert [r["is_duplicate"] for r in M.duplicate_flag(u, [T.normalized("t")], ["i"]).orderBy("i").collect()] == [False, True, True]


@pytest.mark.parametrize("n, test, val", [(1, 0, 0), (2, 0, 1), (3, 1, 1), (10, 1, 1), (50, 2, 5)])
def test_strata(spark, n, test, val):
    got = M.stratified_split(spark.range(n).selectExpr("cast(id as string) k", "'c' c"), "k", "c").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {k: v for k, v in (("test", test), ("val", val), ("train", n - test - val)) if v}


def test_order_statistics_at_whole_positions(spark):
    got = R.order_statistics(spark.range(100), "id", {"a": 0.9, "b": 0.5, "c": 0.99})
    assert {r["name"]: r["value"] for r in got.collect()} == {"a": 90, "b": 50, "c": 99}


@pytest.mark.parametrize("scores, greedy, stop, floor, ties, want", [([50, 85, 99], 100, 80, 40, False, (85, 1)), ([30, 30, 20], 30, 80, 40, False, (30, 0)), ([30, 20, 10], 30, None, 40, True, (30, 9)), ([10, 70, 75], 90, None, 50, False, (75, 2)), ([5], None, 6, 9, True, (5, 0))])
def test_best_of_n(spark, scores, greedy, stop, floor, ties, want):
    rows = [("t", i, s, "drawn") for i, s in enumerate(scores)] + ([("t", 9, greedy, "greedy")] if greedy is not None else [])
    got = R.best_of_n(spark.createDataFrame(rows, "g string, k int, s int, mode string"), "g", "k", "s", "mode", stop, floor, ties).first()
    assert (got["score"], got["attempt"]) == want


def test_plan(spark):
    assert one(spark, P.clean_variants("a"), a="1. one thing\n- two\n\n\"three\"\nx\n2、one thing") == ["one thing", "two", "three"]
    assert one(spark, P.clean_evolved("a"), a="「hello there」 ") == "hello there" and one(spark, P.clean_evolved("a"), a="'abc'") is None
    assert one(spark, P.render("<{x}> {y}", x="a", y=F.lit(None)), a="v") == "<v> "
    assert one(spark, P.error_class("a"), a="Error 402: Insufficient Balance") == "balance"
    rules = [("计时", "，要有开始和暂停"), ("时", "，显示当前时间")]
    assert one(spark, P.enhance("a", rules, "！"), a="计时器，要有开始") == "计时器，要有开始，显示当前时间" and one(spark, P.enhance("a", [], "！"), a="短") == "短！"
    assert one(spark, P.lookup_template("a", [("秒表", "gone"), ("表", "there")], {"there"}), a="做秒表") == "there" and one(spark, P.lookup_template("a", [], {"x"}), a="y") is None
    assert [r["id"] for r in P.shard(spark.range(100).filter("id % 10 <> 0"), "id", 3, 0).orderBy("id").collect()] == [x for i, x in enumerate(x for x in range(100) if x % 10) if i % 3 == 0]


def test_stream(spark, tmp_path):
    from millrace.streaming import gate

    schema, at = "html string, ts timestamp", datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(PAGE, at), (PAGE, at), ("x", at)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    gate.run_available(gate.gated(gate.first_seen(stream, "html", "ts")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["OK", "不以<!DOCTYPE html>开头"]


def test_rules_of_the_reference_by_hand(spark):
    assert one(spark, P.render("{x}-{y}", x="a", y="b"), a="{y}", b="v") == "{y}-v"
    assert one(spark, P.clean_variants("a"), a="1. \"' one thing '”\r\n• two\x0bthree x") == ["one thing", "two", "three x"]
    assert one(spark, P.lookup_template("a", [("bmi", "there")], {"there"}), a="做BMI") == "there" and one(spark, P.lookup_template("a", [("BMI", "there")], {"there"}), a="做bmi") is None
    assert one(spark, P.enhance("a", [("b$", "+suffix")], "！"), a="  ab \n") == "ab+suffix" and one(spark, P.enhance("a", [], "！"), a=" " * 30 + "x") == "x！"
    calls = lambda ok, limited: [(i, float(i < ok), i < limited) for i in range(15)]
    for ok, limited, want in ((15, 0, 15), (15, 1, 10), (12, 0, 10), (11, 0, 5)):
        df = spark.createDataFrame(calls(ok, limited), "i int, v double, l boolean")
        assert P.latency_summary(df, F.col("v") > 0, F.col("l"), "v").first()["advice"] == want


def test_split_by_first_item_and_each_unknown_category(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("m", None, 1), ("m", "a", 2)], "k string, c string, o int")
    assert {(r["k"], r["c"]) for r in M.stratified_split(df, "k", "c", order="o").collect()} == {("k", "b"), ("m", None)}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["x"] * 10 + ["y"] * 7 + [None] * 5 + ["h"] * 3 + ["t"] * 2)], "i int, c string")
    got = {(r["c"], r["split"]): r["count"] for r in M.isolated_split(df, "c", "i", ["h"], ["t"]).groupBy("c", "split").count().collect()}
    assert got == {("x", "train"): 8, ("x", "val"): 2, ("y", "train"): 5, ("y", "val"): 2, (None, "train"): 4, (None, "val"): 1, ("h", "val"): 3, ("t", "train"): 2}


def test_reports(spark):
    df = spark.createDataFrame([("s", 15, 25, 10, 15, 5, 30, 0, 20, 3, 10)], "id string, " + ", ".join(f"{v}_{d} int" for v in ("v1", "v2") for d in R.DIMENSION_MOST))
    got = R.radar(df, ("v1", "v2")).orderBy("version").collect()
    assert got[0]["shares"] == [0.5, 1.0, 0.5, 1.0, 0.5] and got[1]["scores"] == [30, 0, 20, 3, 10]
    flagged = M.reject_duplicates(spark.createDataFrame([(1, "a", True, []), (2, "a", True, ["x"]), (3, None, True, [])], "i int, t string, passed boolean, all_issues array<string>"), ["t"], ["i"], "dup")
    assert [(r["passed"], r["all_issues"]) for r in flagged.orderBy("i").collect()] == [(True, []), (False, ["x", "dup"]), (True, [])]
    wide = R.order_statistics(spark.range(5000).selectExpr("cast(id * 0.5 as double) v"), "v", {"a": 0.5, "b": 0.999})
    assert {r["name"]: r["value"] for r in wide.collect()} == {"a": 1250.0, "b": 2497.5}


def test_token_lengths(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.operators import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "some words here", "<|im_start|>user\n变量 😀<|im_end|>", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = Tokenizer.from_file(path)
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    counted = tokens.token_lengths(df, "text", path)
    assert [r["n_tokens"] for r in counted.orderBy("i").collect()] == want
    assert tokens.within(counted, 100).count() == sum(n <= 100 for n in want)
