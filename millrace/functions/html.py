"""Page scorers. Several incompatible ones exist side by side, with their own constants; they are never merged."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import char_count, col, count, has, hits, points, step, strip

# What the scorers count.
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
STYLE = r"(?is)<style[^>]*>(.*?)</style>"
OPEN_SCRIPT = r"(?i)<script[^>]*>([\s\S]*?)(?:</script>|$)"
OPEN_STYLE = r"(?i)<style[^>]*>([\s\S]*?)(?:</style>|$)"
EVENTS = r"(?i)addEventListener\s*\(|\bonclick\s*=|\boninput\s*=|\bonchange\s*=|\bonkeydown\s*=|\bonsubmit\s*=|\bonkeyup\s*="
STATE = r"\b(?:let|const|var)\s+[A-Za-z_$]"
CONTROL = r"\b(?:if|for|while|switch)\s*\("
FUNCTIONS = [r"\bfunction\s+[A-Za-z_$]\w*\s*\(", r"=>\s*[{(]", r"\b[A-Za-z_$]\w*\s*=\s*function\s*\("]
APIS = r"localStorage|sessionStorage|setInterval|setTimeout|Date\s*\(|Math\.random|Math\.floor|Math\.max|Math\.min|JSON\.(?:parse|stringify)"
DANGLING = ["function(", "const ", "let ", "= function"]
CDN = ["cdn.", "unpkg", "jsdelivr", "googleapis", "cdnjs"]
JS_COUNTERS = {
    "functions": [r"\bfunction\s+\w+", r"=\s*\([^)]*\)\s*=>", r"=\s*function\s*\("],
    "events": [r"addEventListener\s*\("],
    "state": [r"\blet\s+\w+", r"\bvar\s+\w+", r"\bconst\s+\w+"],
    "conditionals": [r"\bif\s*\(", r"\belse\s+if\b", r"\?\s*[\w\s'\"]+\s*:", r"\bswitch\s*\("],
    "loops": [r"\bfor\s*\(", r"\bwhile\s*\(", r"\.forEach\s*\(", r"\.map\s*\("],
}
JS_BANDS = {"chars": [200, 500, 1000, 1800], "functions": [1, 3, 5, 7], "events": [1, 2, 4, 6], "state": [1, 3, 6, 10], "conditionals": [1, 3, 5, 8], "loops": [1, 2, 3, 4]}
INLINE_EVENTS = r"(?i)\bon[a-z]+\s*="
CSS_COUNTERS = {
    "gradients": [r"(?i)linear-gradient\s*\(", r"(?i)radial-gradient\s*\(", r"(?i)conic-gradient\s*\("],
    "keyframes": [r"(?i)@(?:-webkit-)?keyframes\b"],
    "transitions": [r"(?i)\btransition\s*:", r"(?i)\banimation\s*:"],
    "media": [r"(?i)@media\b"],
}
INTERACTIVE = [r"(?i)<button", r"(?i)<input", r"(?i)<select", r"(?i)<textarea", r"(?i)<canvas", r"(?i)<svg", r"(?i)<a\s"]
VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "source"]
RESPONSIVE_6 = ["max-width", "100%", "100vw"]
CDN_6 = ["cdn.", "unpkg", "jsdelivr"]
MOBILE_5, CDN_5, MODERN_5 = r"max-width|100%|100vw|flex|grid", r"cdn\.|unpkg\.com|jsdelivr|googleapis", r"linear-gradient|border-radius|box-shadow"
EVENTS_10, FUNCTION_10 = r"onclick|oninput|onchange|addEventListener", r"function\s+\w+\s*\("
CDN_10 = r"(?i)cdn\.|unpkg\.com|jsdelivr|googleapis|bootstrap|jquery"
SIGNALS_10 = [
    r"linear-gradient", r"border-radius\s*:\s*(1[2-9]|2\d)", r"box-shadow", r"max-width\s*:\s*(3[6-9]\d|4\d\d)",
    r"[\x{1F300}-\x{1FFFF}\x{2600}-\x{27FF}]", r"class=[\"']card[\"']|\.card\s*\{",
]


def extract(c, pattern: str, drop_empty: bool = False) -> Column:
    parts = F.regexp_extract_all(col(c), F.lit(pattern), 1)
    return F.array_join(F.filter(parts, lambda x: x != "") if drop_empty else parts, "\n")


def derive(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds low, js, css (closed tags) and js_open, css_open (tolerant of truncation), so that each is made once."""
    return df.withColumns({
        "low": F.lower(html), "js": extract(html, SCRIPT), "css": extract(html, STYLE),
        "js_open": extract(html, OPEN_SCRIPT, True), "css_open": extract(html, OPEN_STYLE, True),
    })


def clean_code(c) -> Column:
    """Without Markdown fences, from the doctype to the last closing tag."""
    s = strip(c)
    s = F.regexp_replace(s, r"^```[a-zA-Z]*\n?", "")
    s = strip(F.when(F.endswith(s, F.lit("```")), F.regexp_replace(s, r"```$", "")).otherwise(s))
    at = F.locate("<!DOCTYPE", F.upper(s))
    s = F.when(at > 1, F.substring(s, at, F.length(s))).otherwise(s)
    return strip(cut_after_html(s))


def cut_after_html(c) -> Column:
    """Nothing after the last </html>."""
    s = col(c)
    kept = F.regexp_extract(s, r"(?is)^(.*</html>)", 1)
    return F.when(kept != "", kept).otherwise(s)


def strip_fence(c) -> Column:
    """Without a leading fence line and a trailing fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\n?", ""), r"\n?```$", ""))


def strip_fence_line(c) -> Column:
    """Without a leading line that begins with a fence, whatever else it holds, and a trailing fence."""
    s = strip(c)
    s = F.when(F.startswith(s, F.lit("```")), F.regexp_replace(s, r"^[^\n]*\n", "")).otherwise(s)
    return strip(F.when(F.endswith(s, F.lit("```")), F.substring(s, F.lit(1), F.length(s) - 3)).otherwise(s))


def js_depth(js="js") -> Column:
    """J of the five-dimension scorer."""
    funcs = sum((count(js, p) for p in FUNCTIONS[1:]), count(js, FUNCTIONS[0]))
    cap = lambda c, n: F.least(c, F.lit(n).cast("long"))
    return F.struct(
        cap(2 * count(js, EVENTS), 8).alias("events"), cap(count(js, STATE), 6).alias("state"), cap(count(js, CONTROL), 6).alias("control"),
        cap(funcs, 5).alias("funcs"), cap(count(js, APIS), 5).alias("apis"),
    )


def pattern_hit(haystack, pattern: str) -> Column:
    """Whether the pattern is found; a pattern that is no valid expression counts as a plain string."""
    p = pattern.lower()
    try:
        re.compile(p)
    except re.error:
        return F.contains(col(haystack), F.lit(p))
    return col(haystack).rlike(p)


def instruction_follow(features: list[tuple[str, list[str]]], low="low") -> Column:
    """I of the five-dimension scorer: score, hits, missed."""
    if not features:
        none = F.array().cast("array<string>")
        return F.struct(F.lit(25).cast("long").alias("score"), none.alias("hits"), none.alias("missed"))
    found = []
    for label, patterns in features:
        any_hit = F.lit(False)
        for p in patterns:
            any_hit = any_hit | pattern_hit(low, p)
        found.append((label, any_hit))
    hit = F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in found)))
    miss = F.array_compact(F.array(*(F.when(~x, F.lit(n)) for n, x in found)))
    return F.struct(F.bround(F.size(hit) / len(features) * 25).cast("long").alias("score"), hit.alias("hits"), miss.alias("missed"))


def functional(html="html", low="low", js="js") -> Column:
    """F of the five-dimension scorer."""
    balanced = lambda a, b: (a > 0) & (a == b)
    near = lambda a, b: (a > 0) & (F.abs(a - b) <= 1)
    tail = F.right(F.right(low, F.lit(200)), F.lit(50))
    return F.struct(
        points(col(html).rlike(r"(?i)<!doctype\s+html"), 3).alias("doctype"),
        points(has(low, "</html>"), 3).alias("html_close"),
        points(balanced(count(html, r"(?i)<script[^>]*>"), count(html, r"(?i)</script\s*>")), 3).alias("script_balance"),
        points(balanced(count(html, r"(?i)<style[^>]*>"), count(html, r"(?i)</style\s*>")), 2).alias("style_balance"),
        points(near(char_count(js, "{"), char_count(js, "}")), 4).alias("brace_balance"),
        points(near(char_count(js, "("), char_count(js, ")")), 3).alias("paren_balance"),
        points(~has(tail, *DANGLING), 2).alias("no_dangling_tail"),
    )


def css_quality(low="low", css="css") -> Column:
    """C of the five-dimension scorer."""
    colors = F.array_union(F.regexp_extract_all(col(css), F.lit(r"#[0-9a-fA-F]{3,8}\b"), 0), F.regexp_extract_all(col(css), F.lit(r"rgb\s*\([^)]+\)"), 0))
    return F.struct(
        points(has(low, "viewport"), 3).alias("viewport"),
        hits(has(low, "max-width"), has(low, "100%", "100vw", "100vh"), has(css, "@media")).alias("mobile"),
        hits(has(css, "border-radius"), has(css, "box-shadow"), has(css, "linear-gradient", "radial-gradient")).alias("modern_ui"),
        F.least(F.size(colors), F.lit(3)).cast("long").alias("colors"),
        points(~has(low, *CDN), 3).alias("no_cdn"),
    )


def structure(html="html", low="low") -> Column:
    """S of the five-dimension scorer."""
    n = F.length(col(html))
    return F.struct(
        points(col(html).rlike(r"(?i)<html[^>]*\blang="), 2).alias("html_lang"),
        points(has(low, "charset"), 2).alias("meta_charset"),
        points(has(low, "<title"), 2).alias("has_title"),
        points(has(low, "<head") & has(low, "<body"), 2).alias("head_body"),
        F.when(n.between(500, 20000), 2).when(n >= 300, 1).otherwise(0).cast("long").alias("length_ok"),
    )


def _total(df: DataFrame, name: str) -> Column:
    fields = df.schema[name].dataType.names
    return sum((F.col(f"{name}.{f}") for f in fields[1:]), F.col(f"{name}.{fields[0]}"))


def score_100(df: DataFrame, features: list[tuple[str, list[str]]], html: str = "html") -> DataFrame:
    """Adds J, I, F, C, S (structs), their totals, total and length."""
    df = derive(df, html).withColumns({"J": js_depth(), "I": instruction_follow(features), "F": functional(html), "C": css_quality(), "S": structure(html)})
    df = df.withColumns({
        "j_js_depth": F.least(_total(df, "J"), F.lit(30)), "i_instruct": F.col("I.score"), "f_functional": F.least(_total(df, "F"), F.lit(20)),
        "c_css": F.least(_total(df, "C"), F.lit(15)), "s_structure": F.least(_total(df, "S"), F.lit(10)), "length": F.length(html).cast("long"),
    })
    return df.withColumn("total", F.col("j_js_depth") + F.col("i_instruct") + F.col("f_functional") + F.col("c_css") + F.col("s_structure"))


def _sum(c, patterns: list[str]) -> Column:
    return sum((count(c, p) for p in patterns[1:]), count(c, patterns[0]))


def band(value: Column, bounds: list[int]) -> Column:
    return step(value, (bounds[3], 5), (bounds[2], 4), (bounds[1], 3), (bounds[0], 2))


def max_depth(html="html") -> Column:
    """The deepest nesting of tags, void and self-closing ones aside."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(</?\w+[^>]*>)"), 1)
    keep = F.filter(tags, lambda t: ~F.lower(F.regexp_extract(t, r"^</?(\w+)", 1)).isin(*VOID_TAGS) & ~t.rlike(r"^</?\w+[^>]*/\s*>$"))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def move(s, t):
        d = F.when(F.startswith(t, F.lit("</")), F.greatest(s["d"] - 1, F.lit(0))).otherwise(s["d"] + 1)
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(keep, zero, move, lambda s: s["m"].cast("long"))


def detailed(df: DataFrame, adherence: list[tuple[str, list[str]]], keywords: list[str], html: str = "html") -> DataFrame:
    """The second five-dimension scorer, with all counters."""
    df = derive(df, html)
    df = df.withColumns({f"js_{k}": _sum("js_open", p) for k, p in JS_COUNTERS.items()} | {
        "js_chars": F.length("js_open").cast("long"), "js_inline": count(html, INLINE_EVENTS), "css_chars": F.length("css_open").cast("long"),
        "interactive": _sum(html, INTERACTIVE), "max_depth": max_depth(html),
        "unique_tags": F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(r"<(\w+)"), 1), F.lower))).cast("long"),
        "truncated": ~has(F.right(F.col("low"), F.lit(200)), "</html>"), "length": F.length(html).cast("long"),
    } | {f"css_{k}": _sum("css_open", p) for k, p in CSS_COUNTERS.items()})
    df = df.withColumns({f"sub_{k}": band(F.col(f"js_{k}"), b) for k, b in JS_BANDS.items()})
    bonus = F.least(F.lit(2), F.floor(F.col("js_inline") / 2))
    base = sum((F.col(f"sub_{k}") for k in list(JS_BANDS)[1:]), F.col("sub_chars"))
    checks = {label: F.lit(False) for label, _ in adherence}
    for label, patterns in adherence:
        for p in patterns:
            checks[label] = checks[label] | F.col(html).rlike("(?iu)" + p)
    found = hits(*(F.contains("low", F.lit(k.lower())) for k in keywords))
    c = F.col
    df = df.withColumns({
        "j_js": F.when(bonus > 0, F.least(F.lit(30), base + bonus)).otherwise(base),
        "sub_events": F.when(bonus > 0, F.least(F.lit(5), c("sub_events") + bonus)).otherwise(c("sub_events")),
        "i_instruction": 5 * hits(*checks.values()),
        "f_feature": F.bround(found / max(1, len(keywords)) * 10).cast("long") + step(c("interactive"), (6, 10), (4, 8), (3, 6), (2, 4), (1, 2)),
        "c_css": step(c("css_chars"), (1500, 3), (800, 2), (300, 1)) + F.least(c("css_gradients"), F.lit(3)) + F.least(2 * c("css_keyframes"), F.lit(4)) + F.least(c("css_transitions"), F.lit(3)) + points(c("css_media") > 0, 2),
        "s_structure": step(c("unique_tags"), (12, 4), (8, 3), (5, 2), (3, 1)) + step(c("max_depth"), (6, 3), (4, 2), (2, 1)) + step(c("interactive"), (5, 3), (3, 2), (1, 1)),
    })
    return df.withColumn("total", c("j_js") + c("i_instruction") + c("f_feature") + c("c_css") + c("s_structure"))


def six_points(html="html", longest: int = 8000) -> Column:
    """Doctype, close, viewport, responsive, no CDN, length in bounds: a point each."""
    low, n = F.lower(col(html)), F.length(col(html))
    return hits(has(low, "<!doctype"), has(low, "</html>"), has(low, "viewport"), has(low, *RESPONSIVE_6), ~has(low, *CDN_6), n.between(300, longest))


def six_checks(html="html", closed_script: bool = False) -> Column:
    low = F.lower(col(html))
    script = has(low, "<script") & has(low, "</script>") if closed_script else has(low, "<script")
    return F.struct(
        (has(low, "<!doctype") & has(low, "</html>")).alias("runnable"), has(low, "viewport").alias("viewport"), has(low, *RESPONSIVE_6).alias("mobile"),
        (~has(low, *CDN_6)).alias("no_cdn"), has(low, "<style").alias("has_style"), script.alias("has_script"),
    )


def _complete(html) -> Column:
    return F.startswith(F.upper(strip(html)), F.lit("<!DOCTYPE")) & has(F.lower(col(html)), "</html>")


def five_checks(html="html") -> Column:
    """Complete, viewport, mobile, no CDN, modern look: a point each (case counts but for the first)."""
    c = col(html)
    return hits(_complete(html), has(c, "viewport"), c.rlike(MOBILE_5), ~c.rlike(CDN_5), c.rlike(MODERN_5))


def ten_points(html="html", low="low") -> Column:
    """The ten-point scorer: eight dimensions."""
    c, n = col(html), F.length(col(html))
    events, functions = count(html, EVENTS_10), count(html, FUNCTION_10)
    script = F.when(~has(low, "<script"), 0).when((events >= 2) & (functions >= 2), 2).when((events >= 1) | (functions >= 1), 1).otherwise(0)
    return F.struct(
        points(_complete(html)).alias("complete"),
        points(~strip(html).rlike("^(```|~~~)")).alias("no_fence"),
        points(has(c, "viewport")).alias("viewport"),
        step(hits(*(c.rlike(p) for p in SIGNALS_10)), (5, 2), (3, 1)).alias("style"),
        script.cast("long").alias("script"),
        points(~c.rlike(CDN_10)).alias("no_cdn"),
        points(n.between(200, 5000)).alias("length_ok"),
        points(count(html, r"[\x{4e00}-\x{9fff}]") / F.greatest(n, F.lit(1)) > 0.03).alias("language"),
    )


def escape(c) -> Column:
    """Escaped for an attribute."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def delta_text(d: Column) -> Column:
    """+n, n or +-0; -- if missing."""
    return F.when(d.isNull(), "--").when(d > 0, F.concat(F.lit("+"), d.cast("string"))).when(d == 0, "+-0").otherwise(d.cast("string"))
