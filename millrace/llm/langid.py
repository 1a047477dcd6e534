"""Language identification of words by a linear-chain conditional random field.

A word's features are its character n-grams of 1 to 4 with both ends marked (so that its affixes are features of their
own), hashed, and a lexicon flag for each language whose frequent words hold it. Transitions between the labels of
neighbouring words are learned with them, also those between languages, from chains spliced of two. Words are labelled by
forward-backward in chains of CHAIN words, each read with the CONTEXT words before and after it, whose own labels the
neighbouring chains give; a document's language is the label with the greatest sum of word marginals, and its score that
label's share.

The field is fitted on the driver, on a bounded sample: the first TRAIN_CHARS characters of about PER_LANGUAGE labelled
documents of each language, at most TRAIN_WORDS words in all, chosen by a hash of id and text. Prediction sees every word of every text; a worker remembers the emissions of
CACHE_WORDS words.

Edge cases: text that is null or has no letter is ``und`` with score 0; so is every text if nothing is labelled;
rows with a null id count as not held out; of languages with equal sums the first by name wins; repeated rows each give a
row; a long text is read whole; an empty table gives an empty result; columns other than id, text and (for fitting) lang are
not read, and those that clash with the result's are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, ship, small, use_cache

PER_LANGUAGE = 600
TRAIN_WORDS = 200_000
LEXICON = 500
BINS = 1 << 17
TRAIN_CHARS = 20_000
CHAIN, CONTEXT = 48, 8
#: One chain in SPLICE is also learned from together with the end of one in another language.
SPLICE = 4
ROUNDS = 60
CACHE_WORDS = 400_000

WORD = re.compile(r"[^\W\d_]+")


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bins, first bin of each word): hashed n-grams of 1 to 4 of ^word$, word after word."""
    marked = [f"^{w}$" for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # characters to the word's end
    h, columns, keep = np.zeros(len(flat), np.uint64), [], []
    for n in range(1, 5):
        shifted = np.concatenate([flat[n - 1 :], np.zeros(n - 1, np.uint64)])
        h = (h + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        columns.append((h >> np.uint64(20)) % np.uint64(BINS))
        keep.append(left >= n)
    bins, keep = np.stack(columns, 1).astype(np.int64), np.stack(keep, 1)
    per_word = np.add.reduceat(keep.sum(1), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return bins[keep], np.concatenate([[0], np.cumsum(per_word)[:-1]])


class Field:
    """labels, weights (BINS x labels), lexicon ({word: label places}), its weight, transitions (labels x labels)."""

    def __init__(self, labels, weights, lexicon, lex_weight, transitions):
        self.labels, self.weights, self.lexicon, self.lex_weight, self.transitions = labels, weights, lexicon, lex_weight, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the words' scores, scaled so that the greatest is 1."""
        bins, starts = _ngrams(words)
        e = np.add.reduceat(self.weights[bins], starts, axis=0)
        for i, w in enumerate(words):
            for k in self.lexicon.get(w, ()):
                e[i, k] += self.lex_weight
        return np.exp(e - e.max(1, keepdims=True))


def marginals(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Forward-backward over (chains, positions, labels); mask marks the words. With pairs, also expected transitions."""
    t = np.exp(transitions - transitions.max())
    n, size, k = e.shape
    alpha, scale = np.empty_like(e), np.ones((n, size), e.dtype)
    a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = a
    for i in range(1, size):
        x = (a @ t) * e[:, i]
        s = x.sum(1)
        scale[:, i] = np.where(mask[:, i], s, 1)
        a = np.where(mask[:, i, None], x / np.maximum(s, 1e-30)[:, None], a)
        alpha[:, i] = a
    beta, b, moved = np.empty_like(e), np.ones((n, k), e.dtype), np.zeros((k, k))
    beta[:, -1] = b
    for i in range(size - 2, -1, -1):
        m = mask[:, i + 1]
        y = e[:, i + 1] * b / np.maximum(scale[:, i + 1], 1e-30)[:, None]
        if pairs:
            moved += t * (alpha[:, i][m].T.astype(float) @ y[m].astype(float))
        b = np.where(m[:, None], y @ t.T, b)
        beta[:, i] = b
    p = alpha * beta
    p /= np.maximum(p.sum(2, keepdims=True), 1e-30)
    p *= mask[:, :, None]
    return (p, moved) if pairs else p


def _chains(lengths: list[int], context: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word in the flat list, mask, document, mask of the chain's own words) of chains of documents of these lengths."""
    lengths = np.asarray(lengths, np.int64)
    per = -(-lengths // CHAIN)
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    lead = np.minimum(nth * CHAIN, context)  # a chain's first word is a document's word, so masks have no gap before it
    start = nth * CHAIN - lead
    at = start[:, None] + np.arange(CHAIN + 2 * context)
    mask = (at < lengths[doc][:, None]) & (at < ((nth + 1) * CHAIN + context)[:, None])
    own = mask & (at >= (nth * CHAIN)[:, None]) & (at < ((nth + 1) * CHAIN)[:, None])
    places = (np.cumsum(lengths) - lengths)[doc][:, None] + at
    return np.where(mask, places, 0), mask, doc, own


def fit(rows: list[tuple[str, str]]) -> Field | None:
    """A field from (text, language), by Adam on the conditional likelihood."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    place = {x: i for i, x in enumerate(labels)}
    docs = [(w, place[lang]) for t, lang in rows if (w := WORD.findall((t or "").lower()))]
    chains = [(w[i : i + CHAIN], y) for w, y in docs for i in range(0, len(w), CHAIN)]
    step = max(1, -(-sum(len(w) for w, _ in chains) // (TRAIN_WORDS - TRAIN_WORDS // SPLICE)))
    chains = chains[::step]
    if not chains:
        return Field(labels, np.zeros((BINS, len(labels)), np.float32), {}, 0.0, np.zeros((len(labels), len(labels)), np.float32))
    counts = [Counter() for _ in labels]
    for w, y in chains:
        counts[y].update(w)
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, n in c.most_common(LEXICON):
            if n > 1:
                lexicon.setdefault(w, []).append(k)
    index: dict[str, int] = {}
    parts = [[(w, y)] for w, y in chains]
    far = len(chains) // 2  # rows are sorted by text, so the other half may begin with any language
    for i in range(0, len(chains), SPLICE):
        (a, y), (b, z) = chains[i], chains[(i + far) % len(chains)]
        if y != z:
            parts.append([(a[: CHAIN // 2], y), (b[: CHAIN // 2], z)])
    flat = np.array([index.setdefault(w, len(index)) for p in parts for ws, _ in p for w in ws])
    gold = np.array([y for p in parts for ws, y in p for _ in ws])
    places, mask, _, _ = _chains([sum(len(ws) for ws, _ in p) for p in parts])
    words, k = list(index), len(labels)
    bins, starts = _ngrams(words)
    word_of = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(bins))))
    lex = np.zeros((len(words), k), np.float32)
    for i, w in enumerate(words):
        lex[i, lexicon.get(w, [])] = 1
    want = np.bincount(flat * k + gold, minlength=len(words) * k).reshape(-1, k)
    within = mask[:, 1:].sum()
    want_moves = np.zeros((k, k))
    np.add.at(want_moves, (gold[places[:, :-1]][mask[:, 1:]], gold[places[:, 1:]][mask[:, 1:]]), 1)
    w, tr, lw = np.zeros((BINS, k), np.float32), np.zeros((k, k)), 0.0
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, tr, np.zeros(1))]
    for r in range(1, ROUNDS + 1):
        e = np.add.reduceat(w[bins], starts, axis=0) + lw * lex
        e = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)
        p, moved = marginals(e[flat[places]], mask, tr, pairs=True)
        have = np.stack([np.bincount(flat[places][mask], p[:, :, j][mask], minlength=len(words)) for j in range(k)], 1)
        diff = (want - have) / len(flat)
        grads = (
            np.stack([np.bincount(bins, diff[word_of, j], minlength=BINS) for j in range(k)], 1).astype(np.float32) - 1e-6 * w,
            (want_moves - moved) / max(1, within) - 1e-3 * tr,
            np.array([(diff * lex).sum()]),
        )
        new = []
        for x, g, s in zip((w, tr, np.array([lw])), grads, state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            new.append(x + 0.1 * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-6))
        w, tr, lw = new[0].astype(np.float32), new[1], float(new[2][0])
    return Field(labels, w, lexicon, lw, tr.astype(np.float32))


class Labeller:
    """Marginals of words; remembers the emissions of up to CACHE_WORDS words."""

    def __init__(self, field: Field):
        self.field, self.known, self.rows = field, {}, np.empty((0, len(field.labels)), np.float32)

    def __call__(self, docs: list[list[str]]):
        """(marginals, mask, document) of the chains of the documents' words; each word is in the mask of one chain."""
        new = set().union(*docs).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.rows, new = {}, self.rows[:0], set().union(*docs)
            new = sorted(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, self.field.emissions(new).astype(np.float32)])
        flat = np.fromiter((i for d in docs for i in map(self.known.__getitem__, d)), np.int64)
        places, mask, doc, own = _chains([len(d) for d in docs], CONTEXT)
        if not len(flat):
            return np.zeros((0, own.shape[1], len(self.field.labels)), np.float32), own, doc
        return marginals(self.rows[flat[places]], mask, self.field.transitions) * own[:, :, None], own, doc


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter."""
    words = WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most about PER_LANGUAGE labelled texts of each language, chosen by a hash of the id; never a held-out one."""
    may = docs.filter(~held_out(doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(doc_id, F.substring(text, 1, TRAIN_CHARS).alias(text), lang, F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)).alias("_place"))
    counts = {r[lang]: r["n"] for r in may.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n)))])
    chosen = may.filter(F.col("_place") < F.element_at(share, F.col(lang)) * (1 << 20))
    rows = chosen.orderBy("_place", text, lang).select(text, lang).limit(2 * PER_LANGUAGE * len(counts)).toArrow().to_pylist()
    return sorted((r[text], r[lang]) for r in rows)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


_labellers: dict[int, Labeller] = {}


def _labeller(model) -> Labeller:
    if model.id not in _labellers:
        _labellers.clear()
        _labellers[model.id] = Labeller(model.value)
    return _labellers[model.id]


def _begin() -> None:
    """For task functions, which must not name the cache themselves: they would carry a copy of it."""
    use_cache("langid", _labellers.clear)


class _Model:
    def __init__(self, spark, field):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(field)

    @property
    def value(self):
        return self.broadcast.value


def identify(docs: DataFrame, field: Field | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of docs and two more, named by the last parameters; columns of docs of these names are replaced."""
    docs = docs.drop(lang_pred, score)
    names, model, added = docs.columns, _Model(docs.sparkSession, field), [lang_pred, score]

    def run(batches):
        at = names.index(text)
        _begin()
        for batch in small(batches):
            docs_words = [words_of(t) for t in batch.column(at).to_pylist()]
            best, share = ["und"] * len(docs_words), [0.0] * len(docs_words)
            if model.value is not None:
                label = _labeller(model)
                p, mask, doc = label(docs_words)
                total = np.zeros((len(docs_words), len(model.value.labels)))
                np.add.at(total, doc, p.sum(1, dtype=float))
                for i, w in enumerate(docs_words):
                    if w:
                        k = int(total[i].argmax())
                        best[i], share[i] = label.field.labels[k], min(1.0, float(total[i, k] / total[i].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())], [*names, *added])
        release()

    kinds = dict(docs.dtypes)
    return ship(docs).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{lang_pred}` string", f"`{score}` double"]))


def segments(text: str, field: Field) -> list[tuple[int, int, str, float]]:
    """(start, end, language, mean marginal) of each run of words of one language in a code-switched text."""
    spans = [m.span() for m in WORD.finditer(text)]
    if not spans:
        return []
    p, mask, _ = Labeller(field)([[text[a:b].lower() for a, b in spans]])
    p = p[mask]
    best, out = p.argmax(1), []
    for i, (a, b) in enumerate(spans):
        if out and out[-1][2] == best[i]:
            out[-1][1], out[-1][3] = b, [*out[-1][3], p[i, best[i]]]
        else:
            out.append([a, b, best[i], [p[i, best[i]]]])
    return [(a, b, field.labels[k], float(np.mean(x))) for a, b, k, x in out]


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    got = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
