"""Secret scan (operator 10), in built-in functions.

Strict spans (assign, access, hex) are always reported.  Further candidates
are long unbroken strings of key characters.  Each candidate's class (hex,
alnum, base64) sets the Shannon entropy that some window of ``WINDOW``
characters must reach.  Windows slide by one character: the sum of
count * log2(count) changes only by the leaving and the entering character, so
each step updates it from those two counts.  A candidate that looks like words,
an example, a path or a date is not judged as a whole: its harmless pieces are
taken out and what is left between them is judged, so a key behind its name or
path is still found (the span is the whole candidate).  Runs of letters alone
must reach a higher entropy.  Allow-listed candidates and those that overlap a
strict span are not added.

Null or empty texts have no spans; repeated rows are each answered; extra
columns pass through (text is left out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import spans as sp

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
# Only long enough runs: shorter matches are dropped, and a run has no second match in it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Entropy in bits a character that a window must reach, by class.
LEAST = {"hex": 3.0, "alnum": 3.6, "base64": 3.8, "letters": 3.9}
#: Never secrets: no letter, one repeated piece, UUIDs.
ALLOW = [r"^[^A-Za-z]*$", r"^(.{1,4})\1+.{0,3}$", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"]
#: Judged by pieces: no digit, alphabets, words for examples, dates, and paths or
#: words tied by - _ / with at most one digit run.
DOUBTFUL = [
    r"^[^0-9]*$", r"(?i)abcdefghij|0123456789|123456789|example|placeholder|changeme|your[_-]?|xxxx|lorem|test[_-]?key",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^/?([A-Za-z]+[-_/=+])+[A-Za-z]*[0-9]*$", r"^[A-Za-z]+[0-9]{1,4}$",
]
#: Whole pieces that are no part of a key: dates, alphabets, x's, words and short numbers below WINDOW.
PIECE = (r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|(?i:abcdefghij(?:klmnopqrstuvwxyz)?|0?1234567890?)+|[Xx]{4,}|"
         r"(?=[A-Za-z0-9]{1,19}(?![A-Za-z0-9]))(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*+|[A-Z]+)[0-9]{0,4}|[0-9]{1,8})(?![A-Za-z0-9])")


def window_entropy(value: str, width: int = WINDOW) -> str:
    """SQL: highest entropy of ``width`` characters in a row of a string."""
    xlog = lambda n: f"if({n} < 2, 0D, {n} * log2({n}))"
    count = lambda array, c: f"size(filter({array}, y -> y = {c}))"
    out = f"if(i > {width}, {count(f'slice(c, i - {width}, {width})', f'element_at(c, i - {width})')}, 0)"
    into = f"if(i = 1, 0, {count(f'slice(c, greatest(1, i - {width - 1}), least(i - 1, {width - 1}))', 'element_at(c, i)')})"
    step = f"a.s - {xlog('k.o')} + {xlog('(k.o - 1)')} + {xlog('(k.n + 1)')} - {xlog('k.n')}"
    fold = f"""aggregate(sequence(1, size(c)), named_struct('s', 0D, 'low', 1e9D),
        (a, i) -> element_at(transform(
            transform(array(named_struct('o', {out}, 'n', {into})), k -> {step}),
            s -> named_struct('s', s, 'low', if(i >= {width}, least(a.low, s), a.low))), 1),
        a -> log2({width}) - a.low / {width})"""
    return f"element_at(transform(array(split({value}, '')), c -> {fold}), 1)"


def detect(docs: DataFrame, allow: list[str] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """docs' columns but text, plus base and spans (arrays of start, kind,
    end, value; kind is an index into KINDS)."""
    least = LEAST | (least or {})
    allow, doubtful = (ALLOW, DOUBTFUL) if allow is None else (allow, [])
    others = [c for c in docs.columns if c not in ("text", "body_", "base", "spans")]
    t = docs.select(*others, F.coalesce("text", F.lit("")).alias("body_"))
    base = [
        sp.matches("body_", ASSIGN, 0, keep=f"length(regexp_extract({{v}}, {sp.quoted(ASSIGN)}, 2)) >= 6",
                   only_if=f"body_ rlike {sp.quoted('(?i)password|passwd|secret|token|api_?key')}"),
        sp.matches("body_", ACCESS, 1, only_if="contains(body_, 'AKIA')"),
        sp.matches("body_", HEX, 2, only_if=f"body_ rlike {sp.quoted(HEX)}"),
    ]
    t = t.withColumn("base", sp.in_order(*base))
    refused, doubted = (" or ".join(f"{{v}} rlike {sp.quoted(p)}" for p in patterns) or "false" for patterns in (allow, doubtful))
    letters = f"when {doubted} and {{v}} rlike '^[^0-9]*$|^[A-Za-z]+[0-9]{{1,4}}$' then {float(least['letters'])}D " if doubtful else ""
    cut = (f"case when {{v}} rlike '^[0-9a-fA-F]+$' then {float(least['hex'])}D {letters}"
           f"when {{v}} rlike '^[0-9A-Za-z]+$' then {float(least['alnum'])}D else {float(least['base64'])}D end")
    found = sp.matches("body_", CANDIDATE, 3, keep=f"not ({refused})",
                       only_if=f"body_ rlike {sp.quoted(r'[A-Za-z0-9+/_=-]{20}')}")
    t = t.withColumn("found_", sp.apart(found, F.col("base")))
    pieces = f"transform(split(regexp_replace(f.value, {sp.quoted(PIECE)}, ' '), ' '), p -> regexp_replace(p, '^[-_/=+]+', ''))"
    judged = f"if({doubted.replace('{v}', 'f.value')}, filter({pieces}, p -> length(p) >= {WINDOW} and not ({refused.replace('{v}', 'p')})), array(f.value))"
    dense = F.expr(f"filter(found_, f -> exists({judged}, v -> {window_entropy('v')} >= {cut.replace('{v}', 'v')}))")
    return t.withColumn("spans", F.array_sort(F.concat("base", dense))).drop("body_", "found_")
