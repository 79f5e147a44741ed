"""Spelling variant grouping (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one of
the other.  Reduced-alphabet generation finds them: letters are dealt to a few
symbols (by their counts in the vocabulary, so that the symbols are about
equally frequent), and the full one-edit neighbourhood of every reduced word is
generated, the reduced word itself included.  Words that are near have reduced
words that are equal or one edit apart, so a join of the neighbourhoods with
the reduced vocabulary loses none; candidates are verified on the words as
they stand.  A bit map of the reduced vocabulary, of fixed size (``MAP_BITS``),
lets only possible hits leave the task that generates them; it loses nothing,
and beyond some 10^7 reduced words it stops sparing the shuffle.

Two reduced words that many words share (more than ``LARGE`` pairs) are not
multiplied: their words are joined by the word without one code point, which
costs a row per code point, and only pairs of such reduced words are taken
from there, so that no pair comes from both ways.

Null texts hold no word; of a null doc_id the decimal form is empty; repeated
rows count each; very long words are hashed in blocks; an empty table, or one
without repeated words, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb
from storepulse.llm.common import lower_ascii, written

RUN = r"[A-Za-zÀ-ÿ]"
SYMBOLS = 8
LARGE = 4096  # pairs of words behind two reduced words that are verified one by one
MAP_BITS = 25  # 4 MB, whatever the size of the vocabulary
CELLS = 1 << 20  # numbers of a temporary array
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, one code point deleted
    from every run whose hash with the doc_id 31 divides."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {least_count}")


def alphabet(words: DataFrame, symbols: int = SYMBOLS) -> dict[int, int]:
    """Code point -> symbol (1 to ``symbols``); every letter goes to the
    symbol that is least frequent so far.  One row a code point of RUN comes
    to the driver (116 at most)."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count()
    load, out = [0] * symbols, {}
    for c, n in sorted(((r["c"], r["count"]) for r in letters.collect()), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        out[ord(c)] = least + 1
        load[least] += n
    return out


def _by_length(words: list[str]):
    """(rows, code points as a matrix) of words of equal length."""
    rows: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        rows.setdefault(len(w), []).append(i)
    for length, at in rows.items():
        step = max(1, CELLS // length)
        for k in range(0, len(at), step):
            part = at[k:k + step]
            yield np.array(part), np.array([words[i] for i in part], f"<U{length}").view("<u4").reshape(len(part), length)


class Sums:
    """Hashes of sequences of numbers and of these after one edit."""

    def __init__(self, seq: np.ndarray):
        self.seq = seq.astype(np.uint64)
        length = seq.shape[1]
        self.power = np.cumprod(np.array([1] + [_BASE] * (length + 1), np.uint64), dtype=np.uint64)
        self.before = np.zeros((len(seq), length + 1), np.uint64)
        np.cumsum(self.seq * self.power[:length], axis=1, out=self.before[:, 1:])
        self.whole = self.before[:, -1:]

    def own(self) -> np.ndarray:
        return tb.mix(self.whole.copy())[:, 0]

    def _rest(self, at: slice) -> np.ndarray:
        return self.whole - self.before[:, at]

    def deleted(self, at: slice) -> np.ndarray:
        """Without the number at each place."""
        after = self.whole - self.before[:, 1:][:, at]
        return tb.mix(self.before[:, :-1][:, at] + after * np.uint64(_INVERSE))

    def replaced(self, at: slice, symbol: int) -> np.ndarray:
        return tb.mix(self.whole + (np.uint64(symbol) - self.seq[:, at]) * self.power[:-2][at])

    def inserted(self, at: slice, symbol: int) -> np.ndarray:
        """Symbol before each place, the end included."""
        return tb.mix(self.before[:, at] + np.uint64(symbol) * self.power[:-1][at] + self._rest(at) * np.uint64(_BASE))


def neighbourhood(seq: np.ndarray, symbols: int):
    """(row, hash) of every sequence at most one edit from those given (equal
    length, symbols from 1), each once, in blocks."""
    sums = Sums(seq)
    n, length = seq.shape
    yield np.arange(n), sums.own()
    step = max(1, CELLS // n)
    same = np.zeros((n, length + 1), bool)  # equal to the one before
    same[:, 1:length] = seq[:, 1:] == seq[:, :-1]
    for a in range(0, length + 1, step):
        inner = slice(a, min(a + step, length))
        if inner.stop > a:
            keep = ~same[:, inner]
            yield np.nonzero(keep)[0], sums.deleted(inner)[keep]
        ends = slice(a, min(a + step, length + 1))
        for symbol in range(1, symbols + 1):
            if inner.stop > a:
                keep = seq[:, inner] != symbol
                yield np.nonzero(keep)[0], sums.replaced(inner, symbol)[keep]
            keep = np.ones((n, ends.stop - a), bool)  # before an equal one or behind it is the same
            behind = slice(max(a - 1, 0), ends.stop - 1)
            keep[:, 1 if a == 0 else 0:] = seq[:, behind] != symbol
            yield np.nonzero(keep)[0], sums.inserted(ends, symbol)[keep]


def _reduce(points: np.ndarray, symbol_of: dict[int, int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)  # RUN ends at U+00FF
    table[list(symbol_of)] = list(symbol_of.values())
    return table[points]


def reduced(words: DataFrame, symbol_of: dict[int, int]) -> DataFrame:
    """word, n, id and class: the hashes of the word and of its reduced form."""

    def run(batches):
        for batch in batches:
            own, out = np.zeros((2, batch.num_rows), np.uint64)
            for rows, points in _by_length(batch.column(0).to_pylist()):
                own[rows] = Sums(points).own()
                out[rows] = Sums(_reduce(points, symbol_of)).own()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own.view(np.int64)), pa.array(out.view(np.int64))], ["word", "n", "id", "class"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, id long, class long")


def bit_map(classes: DataFrame, bits: int) -> np.ndarray:
    """One bit for every hash of ``class``; at most 2^(bits - 6) rows, of one
    64-bit word each, come to the driver."""
    slot = F.shiftrightunsigned("class", 64 - bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    rows = classes.groupBy((slot / 64).cast("int").alias("at")).agg(F.bit_or(mask).alias("mask"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for batch in rows.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.view(np.uint64)


def neighbours(classes: DataFrame, symbol_of: dict[int, int], symbols: int, bits: int = MAP_BITS) -> DataFrame:
    """a, b: reduced words and those in the vocabulary at most one edit away,
    as hashes; some b that the bit map lets through may not exist."""
    sent = classes.sparkSession.sparkContext.broadcast(bit_map(classes, bits).tobytes())

    def run(batches):
        table = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for rows, points in _by_length(batch.column(1).to_pylist()):
                for at, found in neighbourhood(_reduce(points, symbol_of), symbols):
                    slot = found >> np.uint64(64 - bits)
                    hit = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[rows[at[hit]]].view(np.int64)), pa.array(found[hit].view(np.int64))], ["a", "b"])

    return classes.select("class", "example").mapInArrow(run, "a long, b long")


def without_one(words: DataFrame) -> DataFrame:
    """id (hash of a word), class, kind, key: kind 'at' with one code point
    struck out, 'gone' with one taken out, 'own' as it stands (hashes)."""

    def run(batches):
        for batch in batches:
            classes = batch.column(1).to_numpy()
            for rows, points in _by_length(batch.column(0).to_pylist()):
                sums, length = Sums(points), points.shape[1]
                own = sums.own()
                step = max(1, CELLS // len(rows))
                same = np.zeros(points.shape, bool)
                same[:, 1:] = points[:, 1:] == points[:, :-1]
                parts = [(np.arange(len(rows)), "own", own)]
                for a in range(0, length, step):
                    at = slice(a, min(a + step, length))
                    h, places = sums.deleted(at), np.arange(at.start, at.stop, dtype=np.uint64)
                    parts.append((np.repeat(np.arange(len(rows)), at.stop - a), "at", tb.mix(h + (places + np.uint64(1)) * np.uint64(_BASE)).ravel()))
                    keep = ~same[:, at]
                    parts.append((np.nonzero(keep)[0], "gone", h[keep]))
                for at, kind, key in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at].view(np.int64)), pa.array(classes[rows[at]]), pa.array([kind] * len(at)), pa.array(key.view(np.int64))],
                        ["id", "class", "kind", "key"])

    return words.select("word", "class").mapInArrow(run, "id long, class long, kind string, key long")


def crowded(words: DataFrame, many: DataFrame) -> DataFrame:
    """Near pairs of words in the class pairs ``many`` (a, b), which meet by
    the word without one code point."""
    classes = many.select(F.col("a").alias("class")).union(many.select("b")).distinct()
    some = words.join(classes, "class", "left_semi")
    keys = written(without_one(some), "keys")
    side = lambda kind, i, c: keys.where(f"kind = '{kind}'").select("key", F.col("id").alias(i), F.col("class").alias(c))
    met = None
    for left, right in (("at", "at"), ("gone", "own"), ("own", "gone")):
        part = side(left, "id", "a").join(side(right, "other_id", "b"), "key").where("id <> other_id").drop("key")
        met = part if met is None else met.unionByName(part)
    met = met.join(many, ["a", "b"], "left_semi").select("id", "other_id").distinct()
    one = lambda i, c: some.select(F.col("id").alias(i), F.col("word").alias(f"{c}word"), F.col("n").alias(f"{c}n"))
    return met.join(one("id", ""), "id").join(one("other_id", "other_"), "other_id").drop("id", "other_id")


def near_words(words: DataFrame, symbols: int = SYMBOLS, large: int = LARGE, bits: int = MAP_BITS) -> DataFrame:
    """word, n, other, other_n of every ordered pair of near words."""
    symbol_of = alphabet(words, symbols)
    words = written(reduced(words, symbol_of), "reduced")
    classes = written(words.groupBy("class").agg(F.min("word").alias("example"), F.count("*").alias("size")), "classes")
    size = lambda c: classes.select(F.col("class").alias(c), F.col("size").alias(f"{c}_size"))
    pairs = written(neighbours(classes, symbol_of, symbols, bits).join(size("b"), "b").join(size("a"), "a"), "pairs")

    one = lambda c, p: words.select(F.col("word").alias(f"{c}word"), F.col("n").alias(f"{c}n"), F.col("class").alias(p))
    few = pairs.where(f"a_size * b_size <= {large}").select("a", "b").join(one("", "a"), "a").join(one("other_", "b"), "b")
    few = few.select("word", "n", "other_word", "other_n")
    many = written(pairs.where(f"a_size * b_size > {large}").select("a", "b"), "large")
    both = few.unionByName(crowded(words, many))
    return both.where("word <> other_word").where(F.levenshtein("word", "other_word", 1) == 1).select(
        "word", "n", F.col("other_word").alias("other"), F.col("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by
    pointer jumping; a form is ten times as frequent, so chains are short."""
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(step.join(nxt, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.drop("moved")


def variants(docs: DataFrame, factor: int = 10, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words, **options)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best")
    judged = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    judged = judged.select("word", "n_near", F.when(-F.col("best.minus") >= factor * F.col("n"), F.col("best")).alias("best"))
    judged = written(judged.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return words.join(judged, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
