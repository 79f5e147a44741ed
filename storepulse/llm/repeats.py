"""Suffix-array removal of repeated passages (operator 13).

Every byte covered by a string of ``length`` bytes that starts anywhere else
too is removed.  Strings that start at w and are ``length`` long are the
windows; the work is to find windows that are equal.

Anchors bring equal windows together without sending every window: a window's
key is the smallest hash of the substrings of ``gram`` bytes inside it, which
its content decides.  Consecutive windows with one key (about half as many as
a window has such substrings) make a piece.  Pieces are grouped by key, and

* pieces of equal bytes are one piece with a count; all their windows repeat;
* the different pieces of a key are compared by a suffix array: tasks put the
  pieces of many keys together into shards of about a megabyte, sort their
  suffixes by induced sorting (``induced``) and read from the permuted common
  prefixes which windows occur twice;
* a key with very many different pieces (a short line in a third of all texts)
  is not put into one shard: its pieces are cut again by longer substrings,
  ``GRAMS``, whose keys tell them apart.  With the last, as long as the window,
  equal windows have equal keys and a count decides, so no case is left out.

Equal texts are recognised by their digest first: one of them is searched, with
its number of copies.  Texts are judged by digest (128 bits) and the result is
joined to the rows, where frequent digests are joined by broadcast of at most
``HOTTEST`` rows.

Null or empty texts, and texts shorter than ``length``, lose nothing unless a
shorter length is asked for; rows that repeat a doc_id are documents of their
own, so two equal rows repeat each other; a null doc_id is treated like any
other; very long texts are searched in sections; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm import induced
from storepulse.llm import textbytes as tb
from storepulse.llm.common import written

LENGTH = 400
GRAMS = (100, 250, 350)  # bytes of an anchor: first for all texts, then for crowded keys
CROWD = 1024  # different pieces of a key that go into one shard
SHARD = 1 << 20  # bytes after which a shard is closed
SECTION = 1 << 20  # windows of a long text that are searched at once
WINDOWS = 1 << 19  # sets the bytes of texts whose pieces are held at once: fewer where pieces are short
HOTTEST = 10_000  # rows of a broadcast table
BITS = 1 << 18  # 64-bit words of the text filter: 2 MB, whatever the number of texts
_PLACES = (1 << 22) - 1  # lower bits of a hash that give way to its place in the buffer
_BREAK = b"\xff"  # stands between pieces; ends runs of one byte
PIECES = "start long, n long, key long, d1 long, d2 long, loops boolean"


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    if width == 1:
        return h
    n = len(h) - width + 1
    whole = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    whole[:len(h)] = h
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    starts = np.arange(len(buf) - gram + 1)
    return tb.span_hashes(buf, starts, starts + gram, tb.BYTE_VALUE)


def pieces_of(buf: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(start, number of windows, key, whether a window may occur twice inside)
    of the pieces of texts that lie one after another in buf and end at
    ``ends``; no window crosses an end."""
    if len(buf) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, bool)
    width = length - gram + 1
    h = _gram_hashes(buf, gram)
    # the least hash by its upper bits, of equal ones the leftmost
    packed = h & ~np.uint64(_PLACES) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_minimum(packed, width) & np.uint64(_PLACES)).astype(np.int64)
    key = h[place].view(np.int64)
    n = len(key)
    lengths = np.diff(ends, prepend=0)
    inside = np.zeros(n + 1, np.int32)  # windows that end in their own text
    some = lengths >= length
    first = (ends - lengths)[some]
    np.add.at(inside, first, 1)
    np.add.at(inside, np.minimum(first + lengths[some] - length + 1, n), -1)
    valid = np.cumsum(inside[:-1]) > 0
    begin = np.ones(n, bool)
    begin[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    begin[first] = True
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(begin, at, 0))
    begin |= since % width == 0  # text that repeats itself keeps one key: bounded pieces
    start = np.flatnonzero(begin & valid)
    stop = np.minimum(np.append(np.flatnonzero(begin), n)[np.searchsorted(np.flatnonzero(begin), start, "right")], n)
    # windows that follow the last valid one of a text are not part of its piece
    last = np.append(np.flatnonzero(~valid), n)
    stop = np.minimum(stop, last[np.searchsorted(last, start, "right")])
    # equal windows of one piece have their leftmost least hash at other places
    return start, stop - start, key[start], place[start] != place[stop - 1]


def _sections(texts: pa.Array, length: int):
    """(rows, offsets in their texts, bytes, ends): whole texts together, very
    long ones in overlapping sections whose windows do not overlap."""
    for c in tb.chunks(texts):
        ends = c.offs[1:]
        if len(ends) > 1 or len(c.buf) <= SECTION + length:
            yield c.first + np.arange(len(ends)), np.zeros(len(ends), np.int64), c.buf, ends
            continue
        for a in range(0, len(c.buf) - length + 1, SECTION):
            part = c.buf[a:a + SECTION + length - 1]
            yield np.array([c.first]), np.array([a]), part, np.array([len(part)])


def _digests(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    raw = memoryview(buf)
    blake = hashlib.blake2b
    out = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def cut(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """id1, id2, copies and pieces (columns of PIECES) of every text."""

    most = max(1 << 16, WINDOWS // 100 * min(length - gram + 1, 256))  # bytes of texts whose pieces are held at once

    def slices(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(3)).to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
                yield batch.slice(a, b - a)
                a = b

    def run(batches):
        for batch in slices(batches):
            raw = batch.column(3)
            found = {}
            for rows, shift, buf, ends in _sections(raw, length):
                start, n, key, loops = pieces_of(buf, ends, length, gram)
                digest = _digests(buf, start, n + (length - 1))
                text = np.searchsorted(ends, start, "right")
                begin = np.concatenate(([0], ends[:-1]))[text]
                columns = (start - begin + shift[text], n, key, digest[:, 0], digest[:, 1], loops)
                cuts = np.searchsorted(text, np.arange(len(rows) + 1))
                for k, row in enumerate(rows.tolist()):
                    found.setdefault(row, []).append([c[cuts[k]:cuts[k + 1]] for c in columns])
            count = np.array([sum(len(p[0]) for p in found.get(i, [])) for i in range(batch.num_rows)])
            parts = [p for i in range(batch.num_rows) for p in found.get(i, [])]
            kinds = [np.int64] * 5 + [bool]
            flat = [np.concatenate([np.zeros(0, kind), *[p[k] for p in parts]]).astype(kind) for k, kind in enumerate(kinds)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            structs = pa.StructArray.from_arrays([pa.array(f) for f in flat], ["start", "n", "key", "d1", "d2", "loops"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, structs)], ["id1", "id2", "copies", "pieces"])

    kind = PIECES.replace(" ", ":")
    return texts.select("id1", "id2", "copies", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"id1 long, id2 long, copies long, pieces array<struct<{kind.replace(',:', ',')}>>")


def repeated_windows(pieces: list[bytes], copies: list[int], length: int):
    """With every piece, the runs (start, n) of its windows that occur twice or
    more in the shard, by the suffix array of all pieces."""
    text = _BREAK.join(pieces)
    s = np.frombuffer(text, np.uint8)
    order = induced.suffix_array(s, 256)
    prefix = induced.common_prefixes(s, order)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    own = sizes - length + 1
    weight = np.zeros(len(s) + 1, np.int64)
    np.add.at(weight, begin, copies)
    np.add.at(weight, begin + own, -np.array(copies, np.int64))
    weight = np.cumsum(weight[:-1])  # copies of the window that starts here; 0 where none does
    group = np.cumsum(prefix[order] < length) - 1
    of_window = weight[order]
    twice = (np.bincount(group, of_window) >= 2)[group] & (of_window > 0)
    mark = np.zeros(len(s) + 1, bool)
    mark[order[twice]] = True
    edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    edge = np.concatenate(([0], edge)) if mark[0] else edge
    first, last = edge[::2], edge[1::2]
    piece = np.searchsorted(begin, first, "right") - 1
    return piece, first - begin[piece], last - first


def compare(pieces: DataFrame, length: int) -> DataFrame:
    """id1, id2, start, n: repeated windows of the pieces (key, id1, id2,
    start, copies, bytes), which are compared key by key."""

    def run(batches):
        held, size, current = [], 0, None

        def shard():
            raw, copies = [h[4] for h in held], [h[3] for h in held]
            piece, first, n = repeated_windows(raw, copies, length)
            single = [k for k, p in enumerate(piece.tolist()) if copies[p] == 1]  # the others repeat anyway
            p = [held[piece[k]] for k in single]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in p], pa.int64()), pa.array([x[1] for x in p], pa.int64()),
                 pa.array(np.array([x[2] for x in p], np.int64) + first[single]), pa.array(n[single])], ["id1", "id2", "start", "n"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if key != current and size >= SHARD:
                    yield from shard()
                    held, size = [], 0
                current = key
                held.append(row)
                size += len(row[4])
        if held:
            yield from shard()

    dealt = pieces.select("key", "id1", "id2", "start", "copies", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id1 long, id2 long, start long, n long")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key, whose ``size`` says how many
    rows have the key.  The most frequent keys, HOTTEST of them at most, are
    joined by broadcast where the rows lie, so none fills one task."""
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(10_000, total // HOTTEST)
    frequent = table.where(hot)
    if frequent.isEmpty():
        return rows.join(table, on, how)
    keys = F.broadcast(frequent.select(on))  # at most HOTTEST rows, as they hold more than total / HOTTEST rows each
    return rows.join(F.broadcast(frequent), on).unionByName(
        rows.join(keys, on, "left_anti").join(table.where(~hot), on, how))


def may_hold(rows: DataFrame, ids: DataFrame, column: str = "id1") -> DataFrame:
    """The rows whose ``column`` may be among that of ``ids``, by a bit map of
    fixed size, so that only about these rows are shuffled for an exact join.
    Beyond some 10^7 ids it lets nearly everything through."""
    bit = lambda c: F.pmod(F.col(c), F.lit(64 * BITS))
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    words = ids.select(bit(column).alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask(F.col("bit"))).alias("mask"))
    dense = rows.sparkSession.range(BITS).join(words, F.col("id") == F.col("word"), "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("m")))), lambda w: w["m"]).alias("bits_"))
    kept = rows.crossJoin(F.broadcast(dense))  # one row
    here = F.element_at("bits_", (bit(column) / 64).cast("int") + 1).bitwiseAND(mask(bit(column))) != 0
    return kept.where(here).select(rows.columns)


def _bytes_of(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted pieces (id1, id2, start, n and more) with their bytes."""
    rest = [c for c in wanted.columns if c not in ("id1", "id2")]
    lists = wanted.groupBy("id1", "id2").agg(F.collect_list(F.struct(*rest)).alias("list"))  # bounded by the text
    joined = texts.select("id1", "id2", F.col("text").cast("binary").alias("text")).join(lists, ["id1", "id2"])

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            flat = column.flatten()
            start, n = (flat.field(rest.index(c)).to_numpy() for c in ("start", "n"))
            for a in range(0, len(row), 10_000):
                part = slice(a, a + 10_000)
                held = {k: memoryview(batch.column(2)[k].as_buffer()) for k in np.unique(row[part]).tolist()}
                cut_ = [held[k][i:j].tobytes() for k, i, j in zip(row[part].tolist(), start[part].tolist(), (start + n + (length - 1))[part].tolist(), strict=True)]
                at = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[flat.field(k).slice(a, 10_000) for k in range(len(rest))], pa.array(cut_, pa.binary())],
                    ["id1", "id2", *rest, "bytes"])

    kinds = dict(wanted.dtypes)
    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ["id1", "id2", *rest]) + ", bytes binary")


def find(texts: DataFrame, length: int, grams: tuple[int, ...], crowd: int, first: bool = True) -> DataFrame:
    """id1, id2, start, n: the windows that occur twice or more, of texts (id1,
    id2, copies, text; each id once but for first, where rows are counted) of
    which there is one copy."""
    gram = grams[0] if grams else length
    rows = cut(texts, length, gram)
    if first:
        rows = rows.where("size(pieces) > 0").groupBy("id1", "id2").agg(F.sum("copies").alias("copies"), F.first("pieces").alias("pieces"))
    placed = written(rows.select("id1", "id2", "copies", F.inline("pieces")), "pieces")
    place = F.struct("id1", "id2", "start", "n")
    distinct = written(placed.groupBy("key", "d1", "d2").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.bool_or("loops").alias("loops"), F.min(place).alias("at")), "distinct")
    again = distinct.where("copies >= 2 AND rows >= 2").select("key", "d1", "d2", "rows")
    marks = spread_join(placed.where("copies = 1"), again, ["key", "d1", "d2"], "rows").select("id1", "id2", "start", "n")
    if gram == length:  # a piece is a window
        return marks
    mixed = distinct.groupBy("key").agg(F.count("*").alias("others"), F.min("copies").alias("least"), F.bool_or("loops").alias("loops")).where(
        "least = 1 AND (others > 1 OR loops)")
    wanted = spread_join(distinct, mixed.select("key", "others"), ["key"], "others")
    wanted = written(wanted.select("at.*", "key", "copies", "d1", "d2", "others"), "wanted")
    if first:
        ids = wanted.select("id1", "id2").unionByName(marks.select("id1", "id2")).distinct()
        texts = written(may_hold(texts, ids).groupBy("id1", "id2").agg(F.first("text").alias("text")), "texts")
    few = compare(_bytes_of(texts, wanted.where(f"others <= {crowd}").drop("d1", "d2", "others"), length), length)
    marks = marks.unionByName(few)
    many = wanted.where(f"others > {crowd}").drop("others")
    if not many.isEmpty():
        many = written(_bytes_of(texts, many, length), "crowded")
        inner = find(many.select(F.col("d1").alias("id1"), F.col("d2").alias("id2"), "copies", F.col("bytes").alias("text")), length, grams[1:], crowd, False)
        inner = inner.select(F.col("id1").alias("d1"), F.col("id2").alias("d2"), F.col("start").alias("from"), F.col("n").alias("m"))
        marks = marks.unionByName(many.where("copies = 1").join(inner, ["d1", "d2"]).select("id1", "id2", (F.col("start") + F.col("from")).alias("start"), F.col("m").alias("n")))
    return marks


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("id1"), F.xxhash64(F.lit(13), text).alias("id2"))


def _cut_texts(texts: DataFrame, length: int) -> DataFrame:
    """id1, id2, spans and kept (binary) of texts with their marks (start, n)."""

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, marks in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = []
                for a, n in sorted((m["start"], m["n"]) for m in marks):
                    b = a + n + length - 1
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(b, gone[-1][1])
                    else:
                        gone.append([a, b])
                edges = [0, *[x for g in gone for x in g], len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                spans.append([{"start": a, "end": b} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, kind), pa.array(kept, pa.binary())], ["id1", "id2", "spans", "kept"])

    return texts.select("id1", "id2", "text", "marks").mapInArrow(run, "id1 long, id2 long, spans array<struct<start:long,end:long>>, kept binary")


def judged(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Texts that lose something, by digest: (id1, id2, copies of texts that
    stand in several rows and go whole; id1, id2, spans, kept of the others)."""
    texts = _identified(docs).where(F.octet_length("text") >= length).withColumn("copies", F.lit(1).cast("long"))
    copied = written(texts.groupBy("id1", "id2").agg(F.sum("copies").alias("copies")).where("copies > 1"), "copied")
    marks = written(find(texts, length, tuple(g for g in grams if g < length), crowd), "marks")
    lists = marks.groupBy("id1", "id2").agg(F.collect_list(F.struct("start", "n")).alias("marks"))  # bounded by the text
    touched = may_hold(texts, marks).join(lists, ["id1", "id2"])  # these texts stand in one row each
    return copied, written(_cut_texts(touched, length), "cut")


def removed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the removed runs, in bytes) and
    kept_sha256, one row per input row."""
    copied, part = judged(docs, **options)
    slim = _identified(docs).select("doc_id", "id1", "id2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    cut_ = part.select("id1", "id2", "spans", F.sha2("kept", 256).alias("kept"))
    rows = spread_join(slim, copied, ["id1", "id2"], "copies", "left") if not copied.isEmpty() else slim.withColumn("copies", F.lit(None).cast("long"))
    rows = rows.join(cut_, ["id1", "id2"], "left")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return rows.select(
        "doc_id", "n_bytes", F.when(F.col("copies").isNotNull(), all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copies").isNotNull(), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with what is left of their texts, as bytes in column
    ``kept`` (a cut may fall inside a character); all columns pass through."""
    copied, part = judged(docs, **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("id1"), F.xxhash64(F.lit(13), text).alias("id2"))
    rows = spread_join(rows, copied, ["id1", "id2"], "copies", "left") if not copied.isEmpty() else rows.withColumn("copies", F.lit(None).cast("long"))
    rows = rows.join(part.select("id1", "id2", F.col("kept").alias("left_")), ["id1", "id2"], "left")
    kept: Column = F.when(F.col("copies").isNotNull(), F.lit("").cast("binary")).otherwise(
        F.coalesce("left_", F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "kept"], kept.alias("kept"))
