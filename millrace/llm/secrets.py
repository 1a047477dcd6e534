"""Secret scans whose findings a random forest sifts.

Candidates are known key formats, values assigned to a name such as password or token, and other long strings that mix
digits with letters. Each gets features of its own characters (length, entropy, shares and transitions of character
classes, share covered by dictionary words), of its path and of the words around it; a random forest (Spark ML), trained
from labelled findings, gives the probability that it is a secret.

Labelled findings come as rows (before, value, after, path, label); where a corpus has none, ``labelled_findings``
makes LABELLED of them, half secrets of the usual formats and half look-alikes: digests and ids, placeholders,
identifiers, file names, numbers. Given documents, the dictionary is the corpus's own: at most VOCABULARY most frequent of its
words, counted over all texts; look-alikes are put together from these words, and what stands around the findings is taken
from CONTEXTS places of the texts (a bounded sample, the same each time). Without documents a small fixed dictionary serves.

Edge cases: null or empty text has no candidates; a null path counts as empty; overlapping candidates become one,
specific formats and assigned values before other strings; a private key without its end mark reaches over the encoded
lines that follow its begin mark; values and texts of any length are read whole; repeated rows and null ids each give their
findings; an empty table gives none; other columns of the input, whatever their names, are not looked at. Findings carry a
digest of the value, never the value.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, ship, small, use_cache

LABELLED = 3000
#: The words of the corpus's dictionary, and the places whose words stand around made-up findings.
VOCABULARY, CONTEXTS = 20000, 400
SHORTEST, LONGEST = 4, 12
TREES, DEPTH = 30, 8
THRESHOLD = 0.5
AROUND = 40
SEED = 11

# Key formats.
FORMATS = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s+[A-Za-z0-9+/=]{16,})*(?:\s+[A-Za-z0-9+/]{1,15}={0,2}(?=\s*-----END ))?",
    "assigned": r"(?i:password|passwd|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<assigned_value>[^\s\"',;]{8,})",
    "generic": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
}
KEY_END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
PATTERNS = {k: re.compile(v) for k, v in FORMATS.items()}
_KEY_END = re.compile(KEY_END)
LEAST_RUN = 20
# Words that speak for and against a secret, and a small dictionary.
FOR = re.compile(r"(?i)passw|pwd|secret|token|api.?key|access.?key|credential|bearer|auth|private")
AGAINST = re.compile(r"(?i)sha\d*|md5|commit|checksum|hash|uuid|guid|digest|etag|integrity|version|build|revision|id\b")
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your|xxxx|dummy|sample|test|todo|insert|redacted|<|\{|\*\*\*|0123|1234|abcd")
TESTS = re.compile(r"(?i)test|example|sample|mock|fixture|doc|readme|demo")
DICTIONARY = frozenset(
    "access account action address admin agent album alert alpha apple array asset async audio author backup banner base batch begin black block board body book border bottom brand browser "
    "buffer build button cache call camera card cart case cell center chart check child class click client clock close cloud code color column command common config connect content control "
    "core count cover create current custom data database date debug default delete demo design detail device dialog display document domain down download drag draw drive edit editor email "
    "empty enable engine error event example export feature field file filter final find first flag folder font form format frame function game general global graph green grid group handler "
    "hash head header height help home html icon image import index info input insert item java javascript json key label language large last layout left length level library light line link "
    "list load local lock login main manager map mark master match media member menu message method mode model module mouse move name node note number object open option order page parent "
    "password path phone photo place player plugin point post print process product profile project query random read record remove report request reset response result return right root row "
    "rule sample save scale scene screen script search section select send server service session set shape share show simple size small sort sound source start state status step stop store "
    "string style submit table task team template test text theme time title token tool total track tree type update upload user value version video view web width window word work world write".split()
)
FEATURES = ["length", "entropy", "distinct", "digits", "upper", "symbols", "transitions", "repeats", "hex", "uuid", "dictionary", "placeholder", "format", "assigned", "before_for", "before_against", "after_against", "path_tests", "path_code"]


class Sifter(NamedTuple):
    """A trained forest and the dictionary that its features go by."""

    forest: object
    words: frozenset[str]


def vocabulary(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent words of SHORTEST to LONGEST letters, counted over all texts, most frequent first: all above the
    least of the counts 2^(k/8) that at most VOCABULARY words reach."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"(?<![a-z0-9])[a-z]{{{SHORTEST},{LONGEST}}}(?![a-z0-9])"), 0)
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(counts.withColumn("step", F.floor(8 * F.log2("n"))), "secret-words")
    # A few hundred steps reach the driver, then the words of those that fit.
    total, least = 0, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > VOCABULARY:
            break
        least = r["step"]
    rows = counts.filter(F.col("step") >= least).select("word", "n").collect() if least is not None else []
    discard(counts)
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def contexts(docs: DataFrame, text: str = "text") -> list[list[str]]:
    """The words without digits at a place of each of at most CONTEXTS different texts, those of the least hashes."""
    h = F.xxhash64(text)
    at = F.pmod(h, F.greatest(F.length(text), F.lit(1))).cast("int") + 1
    # A share of the hashes is enough for four times as many texts, so that few rows of each task are sorted.
    least = -(2**63) + min(2**64 - 1, 4 * CONTEXTS * 2**64 // max(1, docs.count()))
    rows = docs.filter(F.length(text) > 0).select(h.alias("h"), F.col(text).substr(at, F.lit(120)).alias("t"))
    rows = rows.filter(F.col("h") <= least).dropDuplicates(["h", "t"]).orderBy("h", "t").limit(CONTEXTS).collect()
    # The first and last of a place's words may be cut.
    words = ([w for w in r["t"].split()[1:-1] if not any(c.isdigit() for c in w)] for r in rows)
    return [w for w in words if w]


def _coverage(value: str, words: frozenset[str] = DICTIONARY) -> float:
    """The share of characters within dictionary words, longest first at each place."""
    t = value.lower()
    i = covered = 0
    while i < len(t):
        n = next((n for n in range(min(LONGEST, len(t) - i), 2, -1) if t[i : i + n] in words), 0)
        covered, i = covered + n, i + (n or 1)
    return covered / max(1, len(t))


def features(kind: str, value: str, before: str, after: str, path: str, words: frozenset[str] = DICTIONARY) -> list[float]:
    v = value
    counts = list(Counter(v).values())
    cls = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in v]
    short = max(1, len(v))
    return [
        float(short), -sum(c / short * math.log2(c / short) for c in counts), len(counts) / short,
        cls.count("d") / short, cls.count("u") / short, cls.count("s") / short,
        sum(a != b for a, b in zip(cls, cls[1:])) / short, sum(a == b for a, b in zip(v, v[1:])) / short,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v))),
        _coverage(v, words), float(bool(PLACEHOLDER.search(v))), float(kind not in ("assigned", "generic")), float(kind == "assigned"),
        float(bool(FOR.search(before))), float(bool(AGAINST.search(before))), float(bool(AGAINST.search(after))),
        float(bool(TESTS.search(path))), float(bool(re.search(r"\.(py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|sh)$", path))),
    ]


def _private_keys(text: str) -> list[tuple[int, int, str]]:
    """From each begin mark to the end mark before the next, or else over the encoded lines that follow; in one pass."""
    begins, ends, out, k = list(PATTERNS["private_key"].finditer(text)), list(_KEY_END.finditer(text)), [], 0
    for m, limit in zip(begins, [*(m.start() for m in begins[1:]), len(text)]):
        while k < len(ends) and ends[k].start() < m.start():
            k += 1
        closed = k < len(ends) and ends[k].start() < limit
        out.append((m.start(), ends[k].end() if closed else m.end(), "private_key"))
    return out


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each candidate, in order and apart.

    Each format is searched over the whole text. Assigned values grow over the specific formats that overlap them, and take
    the kind of the first; of a generic run, what names and values of the others leave over is a candidate of its own.
    """
    text = text or ""
    spans = [(m.start(), m.end(), k) for k, p in PATTERNS.items() if k not in ("assigned", "generic", "private_key") for m in p.finditer(text)]
    spans += _private_keys(text)
    values = [(*m.span("assigned_value"), "assigned") for m in PATTERNS["assigned"].finditer(text)]
    out: list[list] = []
    for a, b, kind in sorted(spans + values):
        if out and a < out[-1][2]:
            last = out[-1]
            last[2] = max(last[2], b)
            last[0] = kind if last[0] == "assigned" else last[0]
        else:
            out.append([kind, a, b])
    taken = sorted([(a, b) for _, a, b in out] + [m.span() for m in PATTERNS["assigned"].finditer(text)])
    i = 0
    for m in PATTERNS["generic"].finditer(text):
        at, end = m.span()
        rest = []
        while i < len(taken) and taken[i][0] < end:
            if taken[i][0] > at:
                rest.append((at, taken[i][0]))
            at = max(at, taken[i][1])
            if taken[i][1] > end:
                break
            i += 1
        rest.append((at, end))
        for a, b in rest:
            v = text[a:b]
            if b - a >= LEAST_RUN and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
                out.append(["generic", a, b])
    return sorted(map(tuple, out), key=lambda c: c[1])


def labelled_findings(n: int = LABELLED, seed: int = SEED, words: list[str] | None = None, around: list[list[str]] | None = None) -> list[tuple[str, str, str, str, int]]:
    """(before, value, after, path, label): made-up findings, label 1 for secrets, of ``words`` and in the places ``around``."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    low, up, dig, hx = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    words = words or sorted(DICTIONARY)
    filler = lambda: " ".join((r.choice(around) if around else r.choices(words, k=4))[-r.randint(1, 4) :]) + " "
    real = [
        lambda: (filler(), "AKIA" + pick(up + dig, 16)),
        lambda: (filler(), "ghp_" + pick(low + up + dig, 36)),
        lambda: (filler(), "xoxb-" + pick(dig, 11) + "-" + pick(low + up + dig, 24)),
        lambda: (filler(), ".".join(("eyJ" + pick(low + up + dig, 20), pick(low + up + dig, 40), pick(low + up + dig + "_-", 43)))),
        lambda: (filler() + r.choice(["password=", "pwd: ", "secret = '", "PASSWORD=\""]), pick(low + up + dig + "!#%&", r.randint(8, 24))),
        lambda: (filler() + r.choice(["password=", "passwd=", "secret: "]), pick(hx, r.randint(12, 24))),
        lambda: (filler() + r.choice(["token = \"", "api_key=", "access_key: ", "auth="]), pick(hx, r.choice([32, 40, 64]))),
        lambda: (filler() + r.choice(["key ", "credential ", "bearer ", "Bearer "]), pick(low + up + dig + "+/", r.randint(28, 64))),
    ]
    false = [
        lambda: (filler() + r.choice(["commit ", "sha1: ", "md5 ", "checksum=", "hash "]), pick(hx, r.choice([32, 40, 64]))),
        lambda: (filler() + r.choice(["id=", "uuid ", "guid: "]), "-".join(pick(hx, k) for k in (8, 4, 4, 4, 12))),
        lambda: (filler() + r.choice(["password=", "token = \"", "api_key: "]), r.choice(["changeme123", "your_password_here", "xxxxxxxxxxxx", "example-token-1234", "<insert-token>", "${API_TOKEN}", "password123test", "dummy_secret_0000"])),
        lambda: (filler(), "".join(w.title() for w in r.choices(words, k=r.randint(4, 6))) + pick(dig, r.randint(1, 3))),
        lambda: (filler(), "_".join(r.choices(words, k=r.randint(4, 6))) + "_" + pick(dig, 2)),
        lambda: (filler(), "/".join(r.choices(words, k=r.randint(3, 6))) + "/v" + pick(dig, 2)),
        lambda: (filler() + "version ", pick(dig, 8) + "-" + "-".join(r.choices(words, k=3))),
        lambda: (filler() + r.choice(["token: ", "auth = "]), ".".join(r.choices(words, k=3)) + "()"),
        lambda: (filler(), pick("ab1", 24)),
        lambda: (filler() + r.choice(["integrity=", "integrity: ", "digest "]), r.choice(["sha256-", "sha384-", "sha512-"]) + pick(low + up + dig + "+/", r.choice([43, 64, 86]))),
        lambda: (filler() + r.choice(["sha256: ", "SHA256 ", "sha512="]), pick(hx, r.choice([64, 128]))),
        lambda: (filler(), "-".join(r.choices(words, k=r.randint(3, 5))) + "-" + pick(dig, r.randint(1, 4))),
        lambda: (filler() + r.choice(["password: ", "secret=", "token: "]), r.choice(["your", "my", "the", "insert", "example"]) + r.choice(["_", "-"]) + r.choice(["_", "-"]).join(r.choices(words, k=2))),
        lambda: (filler() + r.choice(["password=", "secret: ", "api_key="]), r.choice(["${", "{{", "<", "$("]) + "_".join(r.choices(words, k=2)).upper() + r.choice(["}", "}}", ">", ")"])),
    ]
    out = []
    for i in range(n):
        before, value = r.choice(real if i % 2 else false)()
        path = r.choice(["", "", "src" + pick(dig, 2), "app/config.env", "main.py"] if i % 2 else ["", "", "src" + pick(dig, 2), "tests/sample.json", "docs/readme.md", "main.py"])
        out.append((before, value, " " + filler(), path, i % 2))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, docs: DataFrame | None = None, text: str = "text") -> Sifter:
    """A forest from labelled findings (LABELLED of them at most are used), with the dictionary of ``docs``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    own = vocabulary(docs, text) if docs is not None else []
    words = frozenset(own) or DICTIONARY
    if findings is None:
        findings = labelled_findings(words=own, around=contexts(docs, text) if docs is not None else None)
    rows = []
    for before, value, after, path, label in findings[:LABELLED]:
        whole = before + value + after
        spans = [c for c in candidates(whole) if c[1] < len(before) + len(value) and c[2] > len(before)]
        kind, a, b = max(spans, key=lambda c: c[2] - c[1], default=("generic", len(before), len(before) + len(value)))
        rows.append((features(kind, whole[a:b], whole[max(0, a - AROUND) : a], whole[b : b + AROUND], path, words), float(label)))
    df = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    return Sifter(forest.fit(df.coalesce(1)), words)


def scan(docs: DataFrame, model: Sifter, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, id, kind, start, end, value_sha256, probability and is_secret of every candidate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kind_of_id = dict(docs.dtypes)[doc_id]
    words = docs.sparkSession.sparkContext.broadcast(model.words)  # VOCABULARY words at most

    def run(batches):
        use_cache("none", dict)
        for batch in small(batches):
            at, rows = [], []
            for i, (t, p) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for kind, a, b in candidates(t):
                    v = t[a:b]
                    at.append(i)
                    rows.append((kind, a, b, hashlib.sha256(v.encode()).hexdigest(), features(kind, v, t[max(0, a - AROUND) : a], t[b : b + AROUND], p or "", words.value)))
            of, cols = pa.array(at, pa.int64()), list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, k) for c, k in zip(cols, types))], ["key", "id", "kind", "start", "end", "value_sha256", "f"])
        release()

    keyed = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    found = ship(keyed).mapInArrow(run, f"key long, id {kind_of_id}, kind string, start long, end long, value_sha256 string, f array<double>")
    scored = model.forest.transform(found.withColumn("features", array_to_vector("f")))
    p = F.get(vector_to_array("probability"), 1)
    return scored.select("key", "id", "kind", "start", "end", "value_sha256", p.alias("probability")).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every secret of ``found`` replaced by the mark."""
    spans = found.filter("is_secret").groupBy(F.col("key").alias("_millrace_key"), F.col("id").alias("_millrace_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_millrace_spans"))
    own = (F.col("d._millrace_key") == F.col("s._millrace_key")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s._millrace_id"))
    joined = docs.withColumn("_millrace_key", F.xxhash64(doc_id, text)).alias("d").join(spans.alias("s"), own, "left").select(*(f"d.`{c}`" for c in docs.columns), "_millrace_spans")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(
        x["end"].alias("at"), F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out")
    )
    end = lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text)))
    cut = F.when(F.col("_millrace_spans").isNotNull(), F.aggregate("_millrace_spans", start, step, end)).otherwise(F.col(text))
    return joined.withColumn(text, cut).select(*docs.columns)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, train(spark, docs=docs)).withColumnRenamed("id", "doc_id").drop("key")
