"""A registry of queries and their SQL, and small SQL writers."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n(pattern: str, c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def ns(patterns, c: str) -> str:
    return "(" + " + ".join(n(p, c) for p in patterns) + ")"


def any_of(tokens, c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(t)})" for t in tokens) + ")"


def any_match(patterns, c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in patterns) + ")"


def hits(*conditions: str) -> str:
    return "(" + " + ".join(f"CAST({c} AS BIGINT)" for c in conditions) + ")"


def pts(condition: str, k: int) -> str:
    return f"(CASE WHEN {condition} THEN {k} ELSE 0 END)"


def steps(value: str, *rules: tuple[int, int]) -> str:
    return "(CASE " + " ".join(f"WHEN {value} >= {a} THEN {b}" for a, b in rules) + " ELSE 0 END)"


def big(**columns: str) -> str:
    """Columns as BIGINT."""
    return ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in columns.items())


def first_match(rules, c: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of([w.lower() for w in words], c)} THEN {q(k)}" for k, words in rules) + f" ELSE {q(default)} END"
