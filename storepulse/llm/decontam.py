"""Benchmark decontamination by templates (operator 1).

Texts become template tokens: numbers, names (capitalised inside a sentence)
and units (after a number) turn into typed placeholders, the other terms are
lower-cased.  A run of names is one placeholder, and so are numbers with only
white space between them, so a name of another word count still lines up.
Every window of ``WINDOW`` template tokens is hashed.  A bit map
of the benchmark's window hashes (fixed size) lets the scan of the corpus emit
only windows that may match; an exact hash join with the benchmark's windows
then removes the others.  Joined windows are added up per document, item and
stretch of the document, whatever their offsets, so inserted or dropped tokens
cost only the windows they cut.  Stretches are ``2 * STRETCH`` item lengths long
and overlap by half: every passage of up to ``STRETCH`` item lengths lies in one.
In a stretch the slots are compared: the same original value must stand for the
same new value in every window, else the places that disagree do not count.  A
document is contaminated where the places left in one stretch are at least
``least`` of an item's tokens; a token of the document stands for one place only.

Because placeholders match any number, name or unit, re-parameterised copies
of a question are caught like verbatim ones; ``slots_changed`` tells them
apart.  A template window needs ``LITERALS`` tokens that are no placeholders:
placeholders alone prove nothing.  Beside it every window of ``WINDOW`` tokens
is hashed by the tokens themselves, so verbatim copies join exactly however
few literals they have.  Characters of scripts written without spaces (Chinese,
Japanese, Thai, Lao, Khmer, Burmese) are tokens of their own.

Null or empty texts match nothing.  Items shorter than a window are searched as
a whole: by their template from ``SHORTEST`` units, by their own tokens from
one token, so an item of a single word is found wherever that word stands.
Every distinct text of an item_id is searched, and the best one answers for
the item.  Repeated rows are each judged; null doc_ids are judged by their text alone;
an empty benchmark matches nothing; extra columns pass through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb
from storepulse.llm.common import written

WINDOW = 5
SHORTEST = 3
STRETCH = 2  # item lengths that a passage may take in a document, inserted tokens included
LITERALS = 3  # tokens of a window that are no placeholders, at least (or all but one of a shorter one)
MAP_BITS = 23  # the bit map takes 2**MAP_BITS bits, whatever the benchmark's size

#: Units (fixed values).
UNITS = ("kg g mg t lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd l ml liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees mph kmh kb mb gb tb hz khz mhz ghz w kw v").split()

EXACT = np.uint64(0x3C6EF372FE94F82B)  # keeps hashes of tokens apart from hashes of templates
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"()|"]] = True


# First two bytes of the characters of scripts without spaces, as 256 * first + second.
_UNSPACED = np.zeros(1 << 16, bool)
for _a, _b in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE381, 0xE383), (0xE390, 0xE3BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3)):
    _UNSPACED[_a:_b + 1] = True
_UNSPACED[[256 * a + b for a in range(0xE4, 0xEA) for b in range(0x80, 0xC0)]] = True
_BROAD = np.zeros(1 << 16, bool)  # CJK and full-width punctuation
_BROAD[[0xE380, 0xEFBC]] = True


def _scripts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a character of an unspaced script begins or ends, and
    bytes of broad punctuation."""
    pair = (buf[:-1].astype(np.uint16) << np.uint16(8)) | buf[1:]
    at = np.flatnonzero(_UNSPACED[pair])
    mark = np.flatnonzero(_BROAD[pair])
    mark = mark[mark + 2 < len(buf)]
    third = buf[mark + 2]
    # 々 〆 〇 are letters; of U+FF00..FF3F the digits and capitals are terms
    letter = np.where(pair[mark] == 0xE380, (third >= 0x85) & (third <= 0x87), ((third >= 0x90) & (third <= 0x99)) | ((third >= 0xA1) & (third <= 0xBA)))
    mark = mark[~letter]
    return np.unique(np.concatenate([at, at + np.where(buf[at] == 0xF0, 4, 3)])), np.concatenate([mark, mark + 1, mark + 2])


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends = tb.spans(_TERM[raw], np.array([0, len(raw)]))
    return np.sort(tb.span_hashes(raw, starts, ends, tb.BYTE_VALUE_FOLDED))


class Tokens(NamedTuple):
    doc: np.ndarray  # document of each token
    value: np.ndarray  # hash of each token
    head: np.ndarray  # first token of each unit (a literal, a unit or a run that is one placeholder)
    kind: np.ndarray  # template hash of each unit
    slot: np.ndarray  # hash of each unit's tokens; a literal's is its template hash


def _runs(head: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hash of the tokens of each unit, the token's own if it is alone."""
    size = np.diff(np.append(head, len(value)))
    rank = np.arange(len(value)) - np.repeat(head, size)
    factor = np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64)
    factor[0] = 1
    total = np.add.reduceat(value * np.cumprod(factor, dtype=np.uint64)[rank], head)
    return np.where(size == 1, value[head], tb.mix(total))


def template(c: tb.Chunk, units: np.ndarray) -> Tokens:
    """Tokens of a chunk, and the template units they make."""
    buf, offs = c.buf, c.offs
    n = len(buf)
    member = _TERM[buf]
    digit = _DIGIT[buf]
    if n > 2:  # a point or comma between digits belongs to the number
        inner = ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
        edge = np.concatenate([offs[1:-1] - 1, offs[1:-1] - 2])
        inner[edge[(edge >= 0) & (edge < n - 2)]] = False  # not across documents
        member = member.copy()
        member[1:-1] |= inner
    cuts, marks = _scripts(buf)
    if len(marks):
        member = member.copy()
        member[marks] = False
    starts, ends = tb.spans(member, offs)
    if len(cuts):
        cuts = cuts[cuts < n]
        cuts = np.setdiff1d(cuts[member[cuts] & member[cuts - 1] & (cuts > 0)], offs)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    accented = np.zeros(n, bool)  # second bytes of À..Þ, folded like A-Z
    accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    value = tb.span_hashes(buf + np.uint8(0x20) * accented, starts, ends, tb.BYTE_VALUE_FOLDED)
    doc = np.searchsorted(offs, starts, "right") - 1
    if not len(starts):
        return Tokens(doc, value, starts, value, value)
    number = digit[starts]
    stops = np.concatenate(([0], np.cumsum(_STOP[buf])))
    opens = np.ones(len(starts), bool)  # first of a sentence, line or document
    opens[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    upper = np.append((buf >= 65) & (buf <= 90), [False, False])
    upper[:n - 1] |= accented[1:]
    second = starts + 1 + (buf[starts] == 0xC3)
    capital = upper[starts] & (ends > second) & ~upper[second]  # a term in capitals only is no name
    name = capital & ~opens
    unit = np.zeros(len(starts), bool)
    follows = np.flatnonzero(number[:-1] & (doc[:-1] == doc[1:])) + 1
    if len(follows):
        at = np.minimum(np.searchsorted(units, value[follows]), len(units) - 1)
        unit[follows] = units[at] == value[follows]
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    blanks = np.concatenate(([0], np.cumsum(tb.SPACE[buf])))
    same = doc[1:] == doc[:-1]
    spaced = blanks[starts[1:]] - blanks[ends[:-1]] == starts[1:] - ends[:-1]
    joins = same & ((name[1:] & name[:-1] & ~unit[1:] & ~unit[:-1]) | (number[1:] & number[:-1] & spaced))
    head = np.flatnonzero(np.concatenate(([True], ~joins)))
    return Tokens(doc, value, head, kind[head], _runs(head, value))


def windows(c: tb.Chunk, units: np.ndarray, sizes: list[int], exact: list[int]):
    """For each size of template windows, then of exact ones: (size, whether
    exact, document, hash, tokens at which its units begin and the last one
    ends, values of its units, 0 for literals and in exact windows)."""
    t = template(c, units)
    doc = t.doc[t.head]
    first_of = np.searchsorted(t.doc, np.arange(len(c.offs)))
    literal = np.concatenate(([0], np.cumsum(t.kind == t.slot)))
    edge = np.append(t.head, len(t.doc))
    slot = np.where(t.kind == t.slot, np.uint64(0), t.slot)
    for k in sizes:
        g = tb.window_hashes(t.kind, k)
        if not len(g):
            continue
        whole = doc[:len(g)] == doc[k - 1:]
        rich = literal[k:] - literal[:-k] >= min(LITERALS, max(1, k - 1))
        at = np.flatnonzero(whole & rich)
        yield k, False, doc[at], g[at], lambda may, k=k, at=at: (
            edge[at[may][:, None] + np.arange(k + 1)] - first_of[doc[at[may]]][:, None],
            slot[at[may][:, None] + np.arange(k)].view(np.int64))
    for k in exact:
        g = tb.window_hashes(t.value, k) ^ EXACT
        if not len(g):
            continue
        at = np.flatnonzero(t.doc[:len(g)] == t.doc[k - 1:])
        yield k, True, t.doc[at], g[at], lambda may, k=k, at=at: (
            at[may][:, None] + np.arange(k + 1) - first_of[t.doc[at[may]]][:, None], np.zeros((len(may), k), np.int64))


WINDOWS = "size int, exact boolean, hash long, edges array<bigint>, slots array<bigint>"


def _window_rows(frame: DataFrame, key: str, sizes: list[int], exact: list[int], sent=None) -> DataFrame:
    """Windows of every text; with a bit map, only those that it lets pass."""
    def run(batches):
        units = _unit_hashes()
        bits = None if sent is None else np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            for c in tb.chunks(batch.column(1)):
                for k, alike, doc, g, places in windows(c, units, sizes, exact):
                    may = np.arange(len(g)) if bits is None else np.flatnonzero(bits[(g >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
                    if not len(may):
                        continue
                    edges, slots = places(may)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc[may] + c.first)), pa.array(np.full(len(may), k, np.int32)),
                         pa.array(np.full(len(may), alike)), pa.array(g[may].view(np.int64)),
                         *[pa.ListArray.from_arrays(pa.array(np.arange(len(may) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.int64())) for v in (edges, slots)]],
                        ["key", "size", "exact", "hash", "edges", "slots"])

    kind = dict(frame.dtypes)[key]
    return frame.select(key, "text").mapInArrow(run, f"key {kind}, {WINDOWS}")


def _lengths(items: DataFrame) -> DataFrame:
    """Tokens and units of every item."""
    def run(batches):
        units = _unit_hashes()
        for batch in batches:
            n = [np.zeros((2, 0), np.int64)]
            for c in tb.chunks(batch.column(1)):
                t = template(c, units)
                n.append(np.stack([np.bincount(d, minlength=len(c.offs) - 1) for d in (t.doc, t.doc[t.head])]))
            tokens, parts = np.concatenate(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(parts, pa.int64())], ["variant", "tokens", "units"])

    return items.select("variant", "text").mapInArrow(run, "variant long, tokens long, units long")


def find(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, item: str = "item_id") -> DataFrame:
    """doc, item, start (token of the document), covered, tokens, share and
    slots_changed of the best stretch of every document-item pair that covers
    enough of the item.  ``docs`` has a unique column doc."""
    items = benchmark.select(F.col(item).alias("item"), "text").where("text IS NOT NULL AND item IS NOT NULL").dropDuplicates()
    items = items.withColumn("variant", F.xxhash64(F.col("item").cast("string"), "text"))  # one of the item's texts
    lengths = written(_lengths(items).join(items.select("item", "variant"), "variant"), "items")
    below = {c: [r[0] for r in lengths.where(F.col(c).between(least_, WINDOW - 1)).select(c).distinct().collect()]  # below WINDOW
             for c, least_ in (("units", SHORTEST), ("tokens", 1))}
    sizes, exact = (sorted({WINDOW, *below[c]}) for c in ("units", "tokens"))
    known = _window_rows(items, "variant", sizes, exact).withColumnRenamed("key", "variant").join(lengths, "variant")
    known = written(known.where(f"size = {WINDOW} or size = if(exact, tokens, units)"), "known").withColumnsRenamed({"edges": "item_edges", "slots": "item_slots"})

    slot = (F.shiftrightunsigned("hash", 64 - MAP_BITS)).cast("long")
    cells = known.select(F.floor(slot / 8).cast("int").alias("byte"), F.call_function("shiftright", F.lit(128), F.pmod(slot, F.lit(8)).cast("int")).alias("bit"))
    table = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in cells.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most 2**(MAP_BITS - 3) rows
        table[r["byte"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    seen = _window_rows(docs, "doc", sizes, exact, sent).withColumnRenamed("key", "doc")
    hits = written(seen.join(known, ["hash", "size", "exact"]), "hits")
    line = ["doc", "item", "variant", "tokens", "stretch"]
    number = F.floor(F.col("edges")[0] / (STRETCH * F.col("tokens")))
    parts = hits.withColumn("stretch", F.explode(F.array(number, number - 1))).select(*line, F.inline(F.expr(
        "transform(sequence(1, size), i -> named_struct('place', item_edges[i - 1], 'length', item_edges[i] - item_edges[i - 1], "
        "'at', edges[i - 1], 'old', item_slots[i - 1], 'new', slots[i - 1]))")))
    parts = parts.groupBy(*line, "place", "length", "at", "old", "new").agg(F.count("*").alias("windows"))
    # slots of a stretch: which new value each original value takes, by majority of its places
    votes = parts.where("old <> 0").groupBy(*line, "old", "new").agg(F.size(F.collect_set("place")).alias("n"), F.sum("windows").alias("w"))
    chosen = votes.groupBy(*line, "old").agg(F.max_by("new", F.struct("n", "w", F.col("old") == F.col("new"), "new")).alias("chosen"))
    changed = chosen.where("old <> chosen").groupBy(*line).agg(F.count("*").alias("slots_changed"))
    right = parts.join(chosen, [*line, "old"], "left").where("old = 0 or new = chosen")
    places = right.withColumn("place", F.explode(F.expr("sequence(place, place + length - 1)"))).groupBy(*line).agg(F.count_distinct("place").alias("places"))
    stands = right.groupBy(*line, "at").agg(F.max("length").alias("length")).groupBy(*line).agg(F.sum("length").alias("stands"), F.min("at").alias("start"))
    whole = places.join(stands, line).withColumn("covered", F.least("places", "stands")).where(F.col("covered") >= least * F.col("tokens"))
    whole = whole.join(changed, line, "left").select(
        "doc", "item", "start", "covered", "tokens", (F.col("covered") / F.col("tokens")).alias("share"), F.coalesce("slots_changed", F.lit(0)).alias("slots_changed"))
    best = F.max_by(F.struct("start", "covered", "tokens", "share", "slots_changed"), F.struct("share", -F.col("slots_changed"), -F.col("start")))
    return whole.groupBy("doc", "item").agg(best.alias("b")).select("doc", "item", "b.*")


def numbered(docs: DataFrame) -> DataFrame:
    """doc (hash of id and text: equal rows share a verdict) and text."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("doc"), "text")


def judge(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """doc, contaminated documents only: items, best share, slots_changed."""
    return find(numbered(docs), benchmark, least).groupBy("doc").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("share").alias("share"), F.min("slots_changed").alias("slots_changed"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents without contaminated ones."""
    found = written(judge(docs, benchmark, least).select(F.col("doc").alias("leak_")), "leaks")
    return docs.withColumn("mark_", F.xxhash64(F.col("doc_id").cast("string"), "text")).join(
        found, F.col("mark_") == F.col("leak_"), "left_anti").select(docs.columns)
