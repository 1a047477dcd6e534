"""Text kernel: Columns for stripping, hashing, counting and banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that instruction normalisation deletes wherever they stand (a fixed set, not phrases).
DROPPED = "，。！？、,.!? \t\n帮我做个一弄来搞"


#: White space and the separators of files, groups, records and units.
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Removes all white space at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def count(c, pattern: str) -> Column:
    """Number of matches."""
    return F.regexp_count(col(c), F.lit(pattern)).cast("long")


def char_count(c, char: str) -> Column:
    return (F.length(col(c)) - F.length(F.replace(col(c), F.lit(char), F.lit("")))).cast("long")


def has(c, *tokens: str) -> Column:
    """Whether any token occurs."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(col(c), F.lit(t))
    return out


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def points(condition: Column, n: int = 1) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0)).cast("long")


def hits(*conditions: Column) -> Column:
    """How many conditions hold."""
    out = F.lit(0).cast("long")
    for c in conditions:
        out = out + points(c)
    return out


def step(value: Column, *rules: tuple[float, int], otherwise: int = 0) -> Column:
    """The score of the first (least value, score) that ``value`` reaches."""
    out = None
    for least, score in rules:
        out = F.when(value >= least, score) if out is None else out.when(value >= least, score)
    return out.otherwise(otherwise).cast("long")


def issues(*pairs: tuple[Column, object]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs)))


def instruction_hash(c) -> Column:
    return F.md5(col(c))


def code_hash(c) -> Column:
    """Digest without case and white space."""
    return F.md5(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", ""))


def short_key(c) -> Column:
    return F.substring(F.sha1(col(c)), 1, 16)


def normalized(c) -> Column:
    """An instruction without ends, case and the DROPPED characters."""
    return F.translate(F.lower(strip(c)), DROPPED, "")


def keyword_category(c, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first category of which a keyword occurs in the text, without regard to case."""
    low, out = F.lower(col(c)), None
    for category, words in rules:
        hit = has(low, *(w.lower() for w in words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default) if out is not None else F.lit(default)


def token_estimate(chars: Column) -> Column:
    return (chars + 250) / 2.5
