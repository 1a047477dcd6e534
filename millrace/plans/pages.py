"""Queries over web pages: scorers, gates, reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import report as R
from ..operators import validate as V
from .registry import any_match, any_of, big, first_match, hits, n, ns, pts, q, query, steps

#: Features that pages of the standard tables can have; some patterns are no valid expressions.
FEATURES = [("navigation", ["<nav", "menu("]), ("advert", ['class="ad"', "advert"]), ("footer", ["<footer", "*end"]), ("script", ["function", "var "]), ("table", ["<table", "+("])]
ADHERENCE = [("nav", ["<nav", "menu"]), ("title", ["<title>[^<]+"]), ("list", ["<ul", "<ol"]), ("script", ["<script"]), ("ad", ["class=\"ad"])]
KEYWORDS = ["nav", "footer", "copyright", "div", "Home"]
KINDS = [("navigation", ["<nav", "menu"]), ("advert", ['class="ad"']), ("scripted", ["<script"])]

D = f"""WITH d AS (SELECT page_id, html, lower(html) AS low, array_to_string(regexp_extract_all(html, {q(H.SCRIPT)}, 1), chr(10)) AS js,
    array_to_string(regexp_extract_all(html, {q(H.STYLE)}, 1), chr(10)) AS css,
    array_to_string(list_filter(regexp_extract_all(html, {q(H.OPEN_SCRIPT)}, 1), lambda x: x <> ''), chr(10)) AS js_open,
    array_to_string(list_filter(regexp_extract_all(html, {q(H.OPEN_STYLE)}, 1), lambda x: x <> ''), chr(10)) AS css_open FROM pages)"""


def chars(c, x):
    return f"(length({c}) - length(replace({c}, {q(x)}, '')))"


J = " + ".join([f"least(2 * {n(H.EVENTS, 'js')}, 8)", f"least({n(H.STATE, 'js')}, 6)", f"least({n(H.CONTROL, 'js')}, 6)", f"least({ns(H.FUNCTIONS, 'js')}, 5)", f"least({n(H.APIS, 'js')}, 5)"])
near = lambda a, b: f"({a} > 0 AND abs({a} - {b}) <= 1)"
same = lambda a, b: f"({a} > 0 AND {a} = {b})"
FN = " + ".join([
    pts("regexp_matches(html, '(?i)<!doctype\\s+html')", 3), pts("contains(low, '</html>')", 3), pts(same(n(r"(?i)<script[^>]*>", "html"), n(r"(?i)</script\s*>", "html")), 3),
    pts(same(n(r"(?i)<style[^>]*>", "html"), n(r"(?i)</style\s*>", "html")), 2), pts(near(chars("js", "{"), chars("js", "}")), 4), pts(near(chars("js", "("), chars("js", ")")), 3),
    pts("NOT " + any_of(H.DANGLING, "right(right(low, 200), 50)"), 2),
])
CSS = " + ".join([
    pts("contains(low, 'viewport')", 3), hits("contains(low, 'max-width')", any_of(["100%", "100vw", "100vh"], "low"), "contains(css, '@media')"),
    hits("contains(css, 'border-radius')", "contains(css, 'box-shadow')", any_of(["linear-gradient", "radial-gradient"], "css")),
    r"least(len(list_distinct(list_concat(regexp_extract_all(css, '#[0-9a-fA-F]{3,8}\b'), regexp_extract_all(css, 'rgb\s*\([^)]+\)')))), 3)", pts("NOT " + any_of(H.CDN, "low"), 3),
])
ST = " + ".join([
    pts(r"regexp_matches(html, '(?i)<html[^>]*\blang=')", 2), pts("contains(low, 'charset')", 2), pts("contains(low, '<title')", 2), pts("contains(low, '<head') AND contains(low, '<body')", 2),
    "(CASE WHEN length(html) BETWEEN 500 AND 20000 THEN 2 WHEN length(html) >= 300 THEN 1 ELSE 0 END)",
])


def _feature(patterns):
    import re

    out = []
    for p in patterns:
        try:
            re.compile(p)
            out.append(f"regexp_matches(low, {q(p)})")
        except re.error:
            out.append(f"contains(low, {q(p)})")
    return "(" + " OR ".join(out) + ")"


FOUND = hits(*(_feature(p) for _, p in FEATURES))
I = f"CAST(round_even({FOUND} / {len(FEATURES)}.0 * 25, 0) AS BIGINT)"  # noqa: E741


@query(f"{D} SELECT page_id, {big(j_js_depth=J, i_instruct=I, f_functional=FN, c_css=CSS, s_structure=ST, length='length(html)', total=f'{J} + {I} + {FN} + {CSS} + {ST}')} FROM d")
def page_score_100(t):
    return H.score_100(t("pages"), FEATURES).select("page_id", "j_js_depth", "i_instruct", "f_functional", "c_css", "s_structure", "length", "total")


@query(f"{D} SELECT page_id, {I} AS score, {FOUND} AS hit_count, list_aggregate(list_filter([" + ", ".join(f"CASE WHEN NOT {_feature(p)} THEN {q(k)} END" for k, p in FEATURES) + "], lambda x: x IS NOT NULL), 'string_agg', ',') AS missed FROM d")
def page_instruction_features(t):
    got = t("pages").withColumn("low", F.lower("html")).withColumn("i", H.instruction_follow(FEATURES))
    missed = F.array_join("i.missed", ",")
    return got.select("page_id", F.col("i.score").alias("score"), F.size("i.hits").cast("long").alias("hit_count"), F.when(missed != "", missed).alias("missed"))


BANDS = {k: steps(ns(H.JS_COUNTERS[k], "js_open") if k != "chars" else "length(js_open)", *zip(reversed(b), (5, 4, 3, 2))) for k, b in H.JS_BANDS.items()}
INLINE = n(H.INLINE_EVENTS, "html")
JB = "(" + " + ".join(BANDS.values()) + ")"
BONUS = f"least(2, {INLINE} // 2)"
DJ = f"(CASE WHEN {BONUS} > 0 THEN least(30, {JB} + {BONUS}) ELSE {JB} END)"
DI = "5 * " + hits(*(any_match(["(?i)" + p for p in ps], "html") for _, ps in ADHERENCE))
IA = ns(H.INTERACTIVE, "html")
DF = f"CAST(round_even({hits(*(f'contains(low, {q(k.lower())})' for k in KEYWORDS))} / {len(KEYWORDS)}.0 * 10, 0) AS BIGINT) + {steps(IA, (6, 10), (4, 8), (3, 6), (2, 4), (1, 2))}"
CC = {k: ns(p, "css_open") for k, p in H.CSS_COUNTERS.items()}
DC = f"{steps('length(css_open)', (1500, 3), (800, 2), (300, 1))} + least(3, {CC['gradients']}) + least(4, 2 * {CC['keyframes']}) + least(3, {CC['transitions']}) + {pts(CC['media'] + ' > 0', 2)}"
TAGS = r"len(list_distinct(list_transform(regexp_extract_all(html, '<(\w+)', 1), lambda x: lower(x))))"
VOID = "|".join(H.VOID_TAGS)
DEPTH = (
    r"list_reduce(list_prepend({'d': 0, 'm': 0}, list_transform(list_filter(regexp_extract_all(html, '</?\w+[^>]*>'), "
    rf"lambda x: NOT regexp_matches(lower(x), '^</?({VOID})([^\w]|$)') AND NOT regexp_matches(x, '/\s*>$')), lambda x: "
    r"{'d': CASE WHEN x LIKE '</%' THEN -1 ELSE 1 END, 'm': 0})), lambda a, x: {'d': greatest(a.d + x.d, 0), 'm': greatest(a.m, a.d + x.d)}).m"
)
DS = f"{steps(TAGS, (12, 4), (8, 3), (5, 2), (3, 1))} + {steps(DEPTH, (6, 3), (4, 2), (2, 1))} + {steps(IA, (5, 3), (3, 2), (1, 1))}"


@query(f"{D} SELECT page_id, NOT contains(right(low, 200), '</html>') AS truncated, {big(j_js=DJ, i_instruction=DI, f_feature=DF, c_css=DC, s_structure=DS, max_depth=DEPTH, unique_tags=TAGS, interactive=IA, js_inline=INLINE, total=f'{DJ} + {DI} + {DF} + {DC} + {DS}')} FROM d")
def page_score_detailed(t):
    got = H.detailed(t("pages"), ADHERENCE, KEYWORDS)
    names = ["j_js", "i_instruction", "f_feature", "c_css", "s_structure", "max_depth", "unique_tags", "interactive", "js_inline", "total"]
    return got.select("page_id", "truncated", *(F.col(c).cast("long").alias(c) for c in names))


@query(f"{D} SELECT page_id, " + big(**{f"js_{k}": ns(p, "js_open") for k, p in H.JS_COUNTERS.items()}, **{f"css_{k}": v for k, v in CC.items()}) + " FROM d")
def page_counters(t):
    return H.detailed(t("pages"), ADHERENCE, KEYWORDS).select("page_id", *(f"js_{k}" for k in H.JS_COUNTERS), *(f"css_{k}" for k in H.CSS_COUNTERS))


def six(longest):
    return hits("contains(low, '<!doctype')", "contains(low, '</html>')", "contains(low, 'viewport')", any_of(H.RESPONSIVE_6, "low"), f"NOT {any_of(H.CDN_6, 'low')}", f"length(html) BETWEEN 300 AND {longest}")


@query(f"{D} SELECT page_id, {six(8000)} AS score, {six(12000)} AS score_long, contains(low, '<!doctype') AND contains(low, '</html>') AS runnable, contains(low, '<style') AS has_style, contains(low, '<script') AS has_script, contains(low, '<script') AND contains(low, '</script>') AS has_closed_script, NOT {any_of(H.CDN_6, 'low')} AS no_cdn FROM d")
def page_score_6(t):
    got = t("pages").withColumns({"c": H.six_checks(), "k": H.six_checks(closed_script=True)})
    return got.select("page_id", H.six_points().alias("score"), H.six_points(longest=12000).alias("score_long"), "c.runnable", "c.has_style", "c.has_script", F.col("k.has_script").alias("has_closed_script"), "c.no_cdn")


COMPLETE = r"(starts_with(upper(regexp_replace(html, '^\s+|\s+$', '', 'g')), '<!DOCTYPE') AND contains(lower(html), '</html>'))"
FIVE = hits(COMPLETE, "contains(html, 'viewport')", f"regexp_matches(html, {q(H.MOBILE_5)})", f"NOT regexp_matches(html, {q(H.CDN_5)})", f"regexp_matches(html, {q(H.MODERN_5)})")


@query(f"SELECT page_id, {FIVE} AS score FROM pages")
def page_score_5(t):
    return t("pages").select("page_id", H.five_checks().alias("score"))


E10, F10 = n(H.EVENTS_10, "html"), n(H.FUNCTION_10, "html")
TEN = {
    "complete": pts(COMPLETE, 1), "no_fence": pts(r"NOT regexp_matches(regexp_replace(html, '^\s+', ''), '^(```|~~~)')", 1), "viewport": pts("contains(html, 'viewport')", 1),
    "style": steps(hits(*(f"regexp_matches(html, {q(p)})" for p in H.SIGNALS_10)), (5, 2), (3, 1)),
    "script": f"(CASE WHEN NOT contains(low, '<script') THEN 0 WHEN {E10} >= 2 AND {F10} >= 2 THEN 2 WHEN {E10} >= 1 OR {F10} >= 1 THEN 1 ELSE 0 END)",
    "no_cdn": pts(f"NOT regexp_matches(html, {q(H.CDN_10)})", 1), "length_ok": pts("length(html) BETWEEN 200 AND 5000", 1),
    "language": pts(r"len(regexp_extract_all(html, '[\x{4e00}-\x{9fff}]')) / greatest(length(html), 1) > 0.03", 1),
}


@query(f"{D} SELECT page_id, {big(**TEN, total=' + '.join(TEN.values()))} FROM d")
def page_score_10(t):
    got = H.derive(t("pages")).withColumn("s", H.ten_points())
    return got.select("page_id", "s.*").withColumn("total", sum((F.col(k) for k in list(TEN)[1:]), F.col("complete")))


@query("SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?is)</html>') THEN regexp_extract(html, '(?is)^(.*</html>)', 1) ELSE html END) AS cut_md5, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_length FROM pages")
def page_cut_escape(t):
    return t("pages").select("page_id", F.md5(H.cut_after_html("html")).alias("cut_md5"), F.length(H.escape("html")).cast("long").alias("escaped_length"))


@query(r"""WITH f AS (SELECT page_id, html AS body FROM pages), s AS (SELECT page_id, regexp_replace(body, '^\s+|\s+$', '', 'g') AS x FROM f),
c AS (SELECT page_id, CASE WHEN strpos(upper(x), '<!DOCTYPE') > 1 THEN substr(x, strpos(upper(x), '<!DOCTYPE')) ELSE x END AS x FROM s)
SELECT page_id, md5(regexp_replace(CASE WHEN regexp_matches(x, '(?is)</html>') THEN regexp_extract(x, '(?is)^(.*</html>)', 1) ELSE x END, '^\s+|\s+$', '', 'g')) AS clean_md5 FROM c""")
def page_clean_code(t):
    fenced = F.concat(F.lit("```html\n"), F.col("html"), F.lit("```"))
    return t("pages").select("page_id", F.md5(H.clean_code(fenced)).alias("clean_md5"))


LOW = r"regexp_replace(lower(html), '^\s+|\s+$', '', 'g')"
GATE = (
    rf"CASE WHEN NOT regexp_matches({LOW}, '^<!doctype\s+html') THEN '不以<!DOCTYPE html>开头' WHEN NOT regexp_matches({LOW}, '</html>$') THEN '缺少</html>闭合标签' WHEN NOT contains({LOW}, 'viewport') THEN '缺少viewport meta标签' "
    "WHEN length(html) < 200 THEN '代码过短(' || length(html) || '字符，最低200)' WHEN length(html) > 10000 THEN '代码过长(' || length(html) || '字符，最高10000)' "
    + " ".join(f"WHEN regexp_matches({LOW}, {q(p)}) THEN {q('引用了外部CDN: ' + p)}" for p in V.GATE_CDN)
    + f" WHEN NOT contains({LOW}, '<style') THEN '缺少<style>内联CSS标签' WHEN NOT contains({LOW}, '<script') THEN '缺少<script>内联JS标签' WHEN NOT (contains({LOW}, '<head') AND contains({LOW}, '<body')) THEN '缺少<head>或<body>标签' ELSE 'OK' END"
)


@query(f"SELECT page_id, {GATE} AS reason FROM pages")
def page_gate(t):
    return t("pages").select("page_id", V.gate().alias("reason"))


@query(f"SELECT {first_match(KINDS, 'lower(html)', 'other')} AS category, count(*) AS n, count(*) FILTER ({GATE} = 'OK') AS passed, count(*) FILTER ({GATE} = 'OK') / count(*) AS rate FROM pages GROUP BY 1")
def page_gate_stats(t):
    return V.gate_stats(t("pages").select(T.keyword_category("html", KINDS, "other").alias("category"), V.gate().alias("reason")))


@query(f"SELECT {GATE} AS reason, count(*) AS n FROM pages GROUP BY 1")
def page_reject_reasons(t):
    return t("pages").groupBy(V.gate().alias("reason")).agg(F.count("*").alias("n"))


PAD = r"list_max(list_transform(regexp_extract_all(low, 'padding\s*:\s*(\d+)', 1), lambda x: CAST(x AS BIGINT)))"
RAD = r"list_max(list_transform(regexp_extract_all(low, 'border-radius\s*:\s*(\d+)', 1), lambda x: CAST(x AS BIGINT)))"
RESP, DOM = hits(*(f"contains(low, {q(x)})" for x in V.RESPONSIVE)), hits(*(f"contains(js, {q(x)})" for x in V.DOM))
CJK, TEXT = n(r"[\x{4e00}-\x{9fff}]", "html"), r"length(regexp_replace(js, '^\s+|\s+$', '', 'g'))"
STRUCT = "(" + " AND ".join(
    [f"starts_with({LOW}, '<!doctype html')", *(f"contains({LOW}, {q(x)})" for x in ("</html>", "</head>", "</body>", "<style", "<script")), f"NOT {any_match(V.BANNED, LOW)}", f"{n('<!doctype', LOW)} <= 1"]
) + ")"
L = {
    "mobile": f"{pts(any_of(['viewport'], 'low') + ' AND ' + any_of(['width=device-width'], 'low'), 10)} + (CASE WHEN {RESP} >= 2 THEN 10 WHEN {RESP} = 1 THEN 5 ELSE 0 END) + (CASE WHEN {PAD} IS NULL THEN 5 WHEN {PAD} >= 10 THEN 10 WHEN {PAD} >= 6 THEN 5 ELSE 0 END)",
    "visual": f"{pts(any_of(['linear-gradient', 'radial-gradient'], 'low'), 8)} + (CASE WHEN {RAD} >= 10 THEN 7 WHEN {RAD} >= 4 THEN 4 ELSE 0 END) + {pts(any_of(['box-shadow'], 'low'), 5)} + "
    + pts(r"regexp_matches(html, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]')", 5) + f" + (CASE WHEN {CJK} >= 3 THEN 5 WHEN {CJK} >= 1 THEN 3 ELSE 0 END)",
    "logic": f"(CASE WHEN {TEXT} = 0 THEN 0 ELSE {pts(TEXT + ' > 50', 5)} + {pts(f'regexp_matches(js, {q(V.JS_FUNCTION)})', 5)} + (CASE WHEN {DOM} >= 2 THEN 5 WHEN {DOM} = 1 THEN 3 ELSE 0 END) + {pts(any_of(V.EVENT_TOKENS, 'js') + ' OR ' + any_of(V.EVENT_TOKENS, 'html'), 5)} END)",
    "size": "(CASE WHEN length(html) < 300 THEN 2 WHEN length(html) < 500 THEN 10 WHEN length(html) > 8000 THEN 5 WHEN length(html) > 5000 THEN 12 ELSE 20 END)",
}
VAL = D + f", v AS (SELECT page_id, {STRUCT} AS sound, {big(**L)} FROM d), w AS (SELECT page_id, " + ", ".join(f"CASE WHEN sound THEN {k} END AS {k}" for k in L) + ", CASE WHEN sound THEN mobile + visual + logic + size ELSE 0 END AS total_score FROM v)"


@query(f"{VAL} SELECT *, total_score >= 60 AS passed FROM w")
def page_validate(t):
    return V.validate(t("pages")).select("page_id", *L, "total_score", "passed")


@query(f"{D} SELECT page_id, {big(**L)} FROM d")
def page_layers(t):
    return V.layers(t("pages")).select("page_id", *(F.col(k).cast("long").alias(k) for k in L))


@query(f"{VAL} SELECT concat(total_score // 10 * 10, '-', total_score // 10 * 10 + 9) AS bucket, count(*) AS n FROM w GROUP BY 1")
def page_score_buckets(t):
    return R.score_buckets(V.validate(t("pages")), "total_score")


@query(f"{VAL} SELECT avg(mobile) AS mobile, avg(visual) AS visual, avg(logic) AS logic, avg(size) AS size, count(*) AS n, count(*) FILTER (total_score >= 60) AS passed, coalesce(count(*) FILTER (total_score >= 60) / nullif(count(*), 0), 0) AS pass_rate FROM w")
def page_layer_averages(t):
    ok = F.count_if("passed")
    return V.validate(t("pages")).agg(*(F.avg(k).alias(k) for k in L), F.count("*").alias("n"), ok.alias("passed"), F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("pass_rate"))


STR_ISSUES = [(f"NOT starts_with({LOW}, '<!doctype html')", "缺少<!DOCTYPE html>声明"), *((f"NOT contains({LOW}, {q(x)})", f"缺少{x}闭合标签") for x in ("</html>", "</head>", "</body>")), (f"NOT contains({LOW}, '<style')", "缺少<style>标签"), (f"NOT contains({LOW}, '<script')", "缺少<script>标签"), (any_match(V.BANNED, LOW), "引用了外部资源"), (f"{n('<!doctype', LOW)} > 1", "输出了多个HTML文件")]
ISSUES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(m)} END" for c, m in STR_ISSUES) + "], lambda x: x IS NOT NULL)"


@query(f"WITH i AS (SELECT page_id, unnest({ISSUES}) AS issue, generate_subscripts({ISSUES}, 1) AS p FROM pages), c AS (SELECT issue, count(*) AS n, min((page_id, p)) AS f FROM i GROUP BY 1) SELECT issue, n FROM c ORDER BY n DESC, f LIMIT 15")
def page_top_issues(t):
    return R.top_issues(t("pages").withColumn("issues", V.structure_issues()), "issues", "page_id")


@query("SELECT count(*) AS n, count(*) FILTER (NOT contains(upper(html), '<!DOCTYPE')) AS no_doctype, count(*) FILTER (NOT contains(upper(html), '</HTML>')) AS no_close, count(*) FILTER (NOT contains(html, 'viewport')) AS no_viewport, min(length(html)) AS shortest, max(length(html)) AS longest FROM pages")
def page_quality_scan(t):
    lacks = lambda x: F.count_if(F.array_contains("m", x))
    m = t("pages").withColumn("m", V.triad())
    return m.agg(F.count("*").alias("n"), lacks("DOCTYPE").alias("no_doctype"), lacks("</html>").alias("no_close"), lacks("viewport").alias("no_viewport"), F.min(F.length("html")).cast("long").alias("shortest"), F.max(F.length("html")).cast("long").alias("longest"))


@query("SELECT page_id, contains(lower(html), '<!doctype html') AND contains(lower(html), '</html>') AND contains(lower(html), 'viewport') AND contains(lower(html), '<style') AND contains(lower(html), '<script') AS strict, contains(lower(html), '<!doctype html') AND contains(lower(html), '</html>') AND contains(html, 'viewport') AS loose FROM pages")
def page_accept(t):
    return t("pages").select("page_id", V.accept_strict().alias("strict"), V.accept_loose().alias("loose"))


@query(f"{D}, a AS (SELECT page_id, {FN} + {ST} AS s, page_id // 4 AS g, page_id % 4 AS k FROM d), b AS (SELECT * FROM a WHERE k < 3), st AS (SELECT g, min(k) AS m FROM b WHERE s >= 27 GROUP BY 1), e AS (SELECT b.* FROM b LEFT JOIN st USING (g) WHERE m IS NULL OR k <= m), best AS (SELECT g, s, k FROM e QUALIFY row_number() OVER (PARTITION BY g ORDER BY s DESC, k) = 1) SELECT best.g, CAST(CASE WHEN best.s < 24 AND f.s > best.s THEN f.s ELSE best.s END AS BIGINT) AS score, CASE WHEN best.s < 24 AND f.s > best.s THEN f.k ELSE best.k END AS attempt, coalesce(best.s < 24 AND f.s > best.s, false) AS fallback FROM best LEFT JOIN a f ON f.g = best.g AND f.k = 3")
def page_best_of_n(t):
    s = H.score_100(t("pages"), []).select("page_id", (F.col("f_functional") + F.col("s_structure")).alias("s"))
    s = s.select(F.floor(F.col("page_id") / 4).alias("g"), (F.col("page_id") % 4).alias("k"), "s").withColumn("mode", F.when(F.col("k") == 3, "greedy").otherwise("drawn"))
    return R.best_of_n(s, "g", "k", "s", "mode", 27, 24)


PAIR = f"{D}, s AS (SELECT page_id, {ST} AS total, length(html) AS len FROM d), p AS (SELECT a.page_id AS tag, a.total AS v1, b.total AS v2, a.len AS len1, b.len AS len2 FROM s a LEFT JOIN s b ON b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0)"


def _pairs(t):
    s = H.score_100(t("pages"), []).select("page_id", F.col("s_structure").alias("total"), F.col("length").alias("len"))
    one = s.filter("page_id % 2 = 0").select(F.col("page_id").alias("tag"), F.col("total").alias("v1"), F.col("len").alias("len1"))
    two = s.filter("page_id % 2 = 1").select((F.col("page_id") - 1).alias("tag"), F.col("total").alias("v2"), F.col("len").alias("len2"))
    return one.join(two, "tag", "left")


@query(f"{PAIR} SELECT tag, CAST(v1 AS BIGINT) AS v1, CAST(coalesce(v2, 0) AS BIGINT) AS v2, v2 IS NULL AS v2_missing, CASE WHEN v2 IS NULL THEN '--' WHEN v2 > v1 THEN '+' || (v2 - v1) WHEN v2 = v1 THEN '+-0' ELSE CAST(v2 - v1 AS VARCHAR) END AS delta, len2 / nullif(len1, 0) AS ratio FROM p")
def version_pairs(t):
    return _pairs(t).select("tag", "v1", F.coalesce("v2", F.lit(0)).cast("long").alias("v2"), F.col("v2").isNull().alias("v2_missing"), H.delta_text(F.col("v2") - F.col("v1")).alias("delta"), F.try_divide("len2", "len1").alias("ratio"))


@query(f"{PAIR} SELECT count(*) AS n, count(v2) AS n_valid, coalesce(avg(v1) FILTER (v2 IS NOT NULL), 0) AS avg_v1, coalesce(avg(v2), 0) AS avg_v2, count(*) FILTER (v2 > v1) AS wins, count(*) FILTER (v2 = v1) AS ties, count(*) FILTER (v2 < v1) AS losses FROM p")
def version_summary(t):
    return _pairs(t).agg(F.count("*").alias("n"), F.count("v2").alias("n_valid"), F.coalesce(F.avg(F.when(F.col("v2").isNotNull(), F.col("v1"))), F.lit(0.0)).alias("avg_v1"), F.coalesce(F.avg("v2"), F.lit(0.0)).alias("avg_v2"), *R.wins(F.col("v2") - F.col("v1")))


@query(f"{PAIR}, u AS (SELECT tag, 'total' AS metric, v1, v2 FROM p UNION ALL SELECT tag, 'length', len1, len2 FROM p) SELECT tag, metric, CAST(v1 AS BIGINT) AS v1, CAST(v2 AS BIGINT) AS v2, CASE WHEN v2 > v1 THEN '⬆' WHEN v2 < v1 THEN '⬇' ELSE '–' END AS change FROM u")
def version_metrics_long(t):
    rows = _pairs(t).select("tag", F.explode(F.array(F.struct(F.lit("total").alias("metric"), "v1", "v2"), F.struct(F.lit("length").alias("metric"), F.col("len1").alias("v1"), F.col("len2").alias("v2")))).alias("m"))
    return rows.select("tag", "m.*").withColumn("change", F.when(F.col("v2") > F.col("v1"), "⬆").when(F.col("v2") < F.col("v1"), "⬇").otherwise("–"))


DIMS = {"j": (J, 30), "f": (FN, 20), "c": (CSS, 15), "s": (ST, 10)}


@query(f"{D}, s AS (SELECT {', '.join(f'{x} AS {k}' for k, (x, _) in DIMS.items())} FROM d) " + " UNION ALL ".join(f"SELECT {q(k)} AS dimension, avg({k}) AS mean, avg({k}) / {m} * 100 AS percent, repeat('█', CAST(floor(avg({k}) / {m} * 20) AS BIGINT)) AS bar FROM s" for k, (_, m) in DIMS.items()))
def dimension_means(t):
    s = H.score_100(t("pages"), []).agg(F.avg("j_js_depth").alias("j"), F.avg("f_functional").alias("f"), F.avg("c_css").alias("c"), F.avg("s_structure").alias("s"))
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("mean"), F.lit(m).alias("m")) for k, (_, m) in DIMS.items()))).alias("x")).select("x.*")
    return rows.select("dimension", "mean", (F.col("mean") / F.col("m") * 100).alias("percent"), F.expr("repeat('█', int(floor(mean / m * 20)))").alias("bar"))
