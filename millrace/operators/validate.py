"""Validation gates and layer scores of generated pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import SCRIPT, extract
from ..functions.text import col, has, hits, issues, once, points, strip

# What the gates look for, and what they say.
GATE_CDN = [r"cdn\.", r"unpkg\.com", r"jsdelivr", r"googleapis", r"cloudflare", r"bootstrapcdn", r"cdnjs\."]
BANNED = [r"cdn\.", r"unpkg\.com", r"jsdelivr", r"googleapis\.com", r"cdnjs", r"<link\s+[^>]*href\s*=\s*[\"']https?://", r"<script\s+[^>]*src\s*=\s*[\"']https?://"]
RESPONSIVE = ["max-width", "100%", "100vw", "flex", "grid", "media", "vw", "vh"]
DOM = ["getElementById", "querySelector", "innerHTML", "textContent", "addEventListener", "onclick", "style."]
EVENT_TOKENS = ["onclick", "oninput", "onchange", "addEventListener", "setInterval", "setTimeout"]
JS_FUNCTION = r"function\s+\w+|=>\s*\{|const\s+\w+\s*=\s*\("


def _page(html) -> Column:
    """A page's text; a null page is an empty one."""
    return F.coalesce(col(html), F.lit(""))


def gate(html="html") -> Column:
    """OK, or the reason of the first check that fails."""
    return once(strip(F.lower(_page(html))), lambda low: _gate(low, F.length(_page(html))))


def _gate(low: Column, n: Column) -> Column:
    out = (
        F.when(~low.rlike(r"^\s*<!doctype\s+html"), "不以<!DOCTYPE html>开头")
        .when(~low.rlike(r"</html>\s*$"), "缺少</html>闭合标签")
        .when(~has(low, "viewport"), "缺少viewport meta标签")
        .when(n < 200, F.concat(F.lit("代码过短("), n.cast("string"), F.lit("字符，最低200)")))
        .when(n > 10000, F.concat(F.lit("代码过长("), n.cast("string"), F.lit("字符，最高10000)")))
    )
    for p in GATE_CDN:
        out = out.when(low.rlike(p), "引用了外部CDN: " + p)
    out = out.when(~has(low, "<style"), "缺少<style>内联CSS标签").when(~has(low, "<script"), "缺少<script>内联JS标签")
    return out.when(~(has(low, "<head") & has(low, "<body")), "缺少<head>或<body>标签").otherwise("OK")


def gate_stats(df: DataFrame, verdict="reason", category="category") -> DataFrame:
    """Rows, passes and pass rate of each category."""
    ok = F.count_if(F.col(verdict) == "OK")
    return df.groupBy(category).agg(F.count("*").alias("n"), ok.alias("passed"), (ok / F.count("*")).alias("rate"))


def structure_issues(html="html") -> Column:
    return once(F.lower(strip(_page(html))), _structure_issues)


def _structure_issues(low: Column) -> Column:
    banned = F.lit(False)
    for p in BANNED:
        banned = banned | low.rlike(p)
    return issues(
        (~F.startswith(low, F.lit("<!doctype html")), "缺少<!DOCTYPE html>声明"),
        *((~has(low, t), f"缺少{t}闭合标签") for t in ("</html>", "</head>", "</body>")),
        (~has(low, "<style"), "缺少<style>标签"),
        (~has(low, "<script"), "缺少<script>标签"),
        (banned, "引用了外部资源"),
        (F.regexp_count(low, F.lit("<!doctype")) > 1, "输出了多个HTML文件"),
    )


def _largest(low: Column, pattern: str) -> Column:
    """The largest captured number; one too long for a long counts as very large; null if there is none."""
    numbers = F.transform(F.regexp_extract_all(low, F.lit(pattern), 1), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(2**62)))
    return F.array_max(numbers)


def layers(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds the scores mobile, visual, logic, size and their issues (arrays named *_issues)."""
    df = df.withColumn("_html", _page(html))
    html, c = "_html", F.col("_html")
    df = df.withColumns({"_low": F.lower(html), "_js": extract(html, SCRIPT)})
    df = df.withColumns({
        "_pad": _largest(F.col("_low"), r"padding\s*:\s*(\d+)"), "_radius": _largest(F.col("_low"), r"border-radius\s*:\s*(\d+)"),
        "_cjk": F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]")), "_resp": hits(*(has("_low", t) for t in RESPONSIVE)),
        "_dom": hits(*(has("_js", t) for t in DOM)), "_event": has("_js", *EVENT_TOKENS) | has(html, *EVENT_TOKENS),
        "_n": F.length(html), "_text": F.length(strip("_js")),
    })
    pad, radius, cjk, resp, dom, n = (F.col(x) for x in ("_pad", "_radius", "_cjk", "_resp", "_dom", "_n"))
    view = has("_low", "viewport") & has("_low", "width=device-width")
    grad, emoji = has("_low", "linear-gradient", "radial-gradient"), c.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")
    func, blank = F.col("_js").rlike(JS_FUNCTION), F.col("_text") == 0
    num = lambda fmt, x: F.format_string(fmt, x)
    logic = points(F.col("_text") > 50, 5) + points(func, 5) + F.when(dom >= 2, 5).when(dom == 1, 3).otherwise(0) + points(F.col("_event"), 5)
    df = df.withColumns({
        "mobile": points(view, 10) + F.when(resp >= 2, 10).when(resp == 1, 5).otherwise(0) + F.when(pad.isNull(), 5).when(pad >= 10, 10).when(pad >= 6, 5).otherwise(0),
        "visual": points(grad, 8) + F.when(radius >= 10, 7).when(radius >= 4, 4).otherwise(0) + points(has("_low", "box-shadow"), 5) + points(emoji, 5) + F.when(cjk >= 3, 5).when(cjk >= 1, 3).otherwise(0),
        "logic": F.when(blank, F.lit(0).cast("long")).otherwise(logic),
        "size": F.when(n < 300, 2).when(n < 500, 10).when(n > 8000, 5).when(n > 5000, 12).otherwise(20).cast("long"),
        "mobile_issues": issues((~view, "缺少viewport meta标签"), (resp == 1, "响应式信号不足"), (resp == 0, "缺少响应式布局"), ((pad >= 6) & (pad < 10), num("按钮padding偏小(%dpx)", pad)), (pad < 6, num("按钮padding过小(%dpx)", pad))),
        "visual_issues": issues((~grad, "缺少渐变背景"), (radius < 4, "圆角过小"), (radius.isNull(), "缺少圆角样式"), (~has("_low", "box-shadow"), "缺少阴影效果"), (~emoji, "标题缺少emoji"), (cjk == 0, "界面缺少中文")),
        "logic_issues": F.when(blank, F.array(F.lit("缺少JavaScript逻辑"))).otherwise(issues((F.col("_text") <= 50, "JS代码过短"), (~func, "缺少函数定义"), (dom == 1, "DOM交互偏少"), (dom == 0, "缺少DOM交互"), (~F.col("_event"), "缺少事件处理"))),
        "size_issues": issues((n < 300, num("代码过短(%d字符)", n)), ((n >= 300) & (n < 500), num("代码偏短(%d字符)", n)), (n > 8000, num("代码过长(%d字符)", n)), ((n > 5000) & (n <= 8000), num("代码偏长(%d字符)", n))),
    })
    return df.drop("_html", "_low", "_js", "_pad", "_radius", "_cjk", "_resp", "_dom", "_event", "_n", "_text")


def validate(df: DataFrame, html: str = "html", least: int = 60) -> DataFrame:
    """Adds all_issues, the layers (null where the structure fails), total_score and passed."""
    names = ["mobile", "visual", "logic", "size"]
    df = layers(df.withColumn("structure_issues", structure_issues(html)), html)
    sound = F.size("structure_issues") == 0
    df = df.withColumns({n: F.when(sound, F.col(n)) for n in names})
    every = F.concat(*(f"{n}_issues" for n in names))
    df = df.withColumns({"all_issues": F.when(sound, every).otherwise(F.col("structure_issues")), "total_score": F.coalesce(F.col("mobile") + F.col("visual") + F.col("logic") + F.col("size"), F.lit(0).cast("long"))})
    return df.withColumn("passed", sound & (F.col("total_score") >= least)).drop("structure_issues", *(f"{n}_issues" for n in names))


def triad(html="html") -> Column:
    """What a page lacks of doctype, closing tag and viewport."""
    page = _page(html)
    return issues((~has(F.upper(page), "<!DOCTYPE"), "DOCTYPE"), (~has(F.upper(page), "</HTML>"), "</html>"), (~has(page, "viewport"), "viewport"))


def accept_strict(html="html") -> Column:
    low = F.lower(_page(html))
    return has(low, "<!doctype html") & has(low, "</html>") & has(low, "viewport") & has(low, "<style") & has(low, "<script")


def accept_loose(html="html") -> Column:
    low = F.lower(_page(html))
    return has(low, "<!doctype html") & has(low, "</html>") & has(_page(html), "viewport")


def request_ok(instruction, temperature, max_tokens, top_p) -> Column:
    return F.length(col(instruction)).between(2, 500) & col(temperature).between(0, 1) & col(max_tokens).between(64, 4096) & col(top_p).between(0.1, 1)
