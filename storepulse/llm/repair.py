"""Re-Pair grammar compression of token ids (operator 8).

A block of ids is compressed in rounds.  A round counts all adjacent pairs,
makes a nonterminal of each of the most frequent ones and replaces their
occurrences from left to right; nonterminals take part in later rounds.  Rounds
go on until no pair occurs ``FEWEST`` times, the number from which a rule saves
more than it costs: 12 bytes (two symbols and a length of four bytes each)
against two bytes an occurrence.
Stored are the rules (two symbols each), every rule's expansion length and the
remaining sequence, so a reader finds any token position from running sums of
expansion lengths and expands only the symbols it needs.

Texts are encoded where they lie; only their ids, two bytes each where the
vocabulary allows, are shuffled into the shards.

File format: one Parquet row per block of whole documents (columns of BLOCKS).
Symbols below ``first`` are ids, the others are rules in order of creation;
all numbers are little-endian.

Null or empty texts are documents of the end id alone; rows that repeat a
doc_id follow each other, in the order of their ids inside a shard, and each
get their own range; null doc_ids come first; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm import tokens
from storepulse.llm.common import small_batches, written

BLOCK = 1 << 20  # tokens after which a block is closed
RULES = 3000  # new rules a round at most
RULE = 12  # stored bytes of a rule
FEWEST = RULE // 2 + 1  # occurrences that make a pair frequent
SHARDS = 4096  # shards whose sizes are summed in one group
_SLOTS = 17

BLOCKS = ("shard long, block int, n_tokens long, first long, nulls long, doc_ids binary, doc_lengths binary, "
          "rules binary, rule_lengths binary, symbols binary, width int")


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def compress(ids: np.ndarray, first: int, rounds: int | None = None, limit: int = RULES, fewest: int = FEWEST):
    """(symbols, rules as an (n, 2) array) of the ids, all below ``first``;
    without ``rounds``, until no pair is frequent."""
    seq = ids.astype(np.uint32)
    rules = np.zeros((0, 2), np.uint32)
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        narrow = first + len(rules) <= 1 << 16
        if narrow:
            key = (seq[:-1] << np.uint32(16)) | seq[1:]
        else:
            key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        ordered = np.sort(key)
        at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(at, len(ordered)))
        often = np.flatnonzero(count >= fewest)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")[:limit]]
        pair = ordered[at[often]].astype(np.uint64)
        # one pair a slot; the less frequent ones wait for a later round
        slot = _slot(pair)
        _, own = np.unique(slot, return_index=True)
        own.sort()
        pair, slot = pair[own], slot[own]
        rule_of = np.full(1 << _SLOTS, -1, np.int32)
        rule_of[slot] = np.arange(len(pair), dtype=np.int32)
        found = rule_of[_slot(key.astype(np.uint64))]
        hit = np.flatnonzero(found >= 0)
        hit = hit[pair[found[hit]] == key[hit]]
        if not len(hit):
            break
        order = np.arange(len(hit))
        begins = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
        hit = hit[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
        rule = found[hit]
        used = np.bincount(rule, minlength=len(pair)) >= 2
        hit, rule = hit[used[rule]], rule[used[rule]]
        if not len(hit):
            break
        number = np.cumsum(used) - 1 + first + len(rules)
        pair = pair[used]
        if narrow:
            new = np.stack([pair >> np.uint64(16), pair & np.uint64(0xFFFF)], 1)
        else:
            new = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1)
        rules = np.concatenate([rules, new.astype(np.uint32)])
        seq[hit] = number[rule].astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
    return seq, rules


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of each rule (rules refer to earlier ones only)."""
    length = np.ones(len(rules), np.int64)
    known = np.zeros(len(rules), bool)
    while not known.all():
        parts = []
        ready = ~known
        for side in (0, 1):
            ref = rules[:, side].astype(np.int64) - first
            inner = ref >= 0
            at = np.maximum(ref, 0)
            ready &= ~inner | known[at]
            parts.append(np.where(inner, length[at], 1))
        length[ready] = (parts[0] + parts[1])[ready]
        known |= ready
    return length


def expansions(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions one after another, and where each begins."""
    begin = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.zeros(begin[-1], np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        at = begin[k]
        for s in (a, b):
            if s < first:
                flat[at] = s
                at += 1
            else:
                j = s - first
                flat[at:at + lengths[j]] = flat[begin[j]:begin[j + 1]]
                at += lengths[j]
    return flat, begin


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids behind the symbols."""
    symbols = symbols.astype(np.int64)
    if not len(rules):
        return symbols.astype(np.uint32)
    flat, begin = expansions(rules, lengths, first)
    flat = np.concatenate([flat, np.arange(first, dtype=np.uint32)])  # an id expands to itself
    inner = symbols >= first
    ref = np.where(inner, symbols - first, 0)
    size = np.where(inner, lengths[ref], 1)
    source = np.where(inner, begin[ref], begin[-1] + symbols)
    target = np.cumsum(size) - size
    return flat[np.repeat(source - target, size) + np.arange(size.sum())]


def decode_range(block: dict, start: int, end: int) -> np.ndarray:
    """Ids [start, end) of a block: only the symbols that cover them are expanded."""
    symbols = np.frombuffer(block["symbols"], f"<u{block['width']}")
    rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    lengths = np.frombuffer(block["rule_lengths"], "<u4").astype(np.int64)
    first = block["first"]
    ref = symbols.astype(np.int64) - first
    size = np.where(ref >= 0, lengths[np.maximum(ref, 0)], 1) if len(rules) else np.ones(len(symbols), np.int64)
    ends = np.cumsum(size)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
    before = int(ends[a] - size[a]) if a < len(ends) else start
    return expand(symbols[a:b], rules, lengths, first)[start - before:end - before]


def _block_row(shard: int, block: int, ids: list[np.ndarray], doc_ids: list, first: int) -> list:
    lengths = np.array([len(b) for b in ids], "<i8")
    flat = np.concatenate(ids).astype(np.uint32, copy=False)
    symbols, rules = compress(flat, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    nulls = sum(d is None for d in doc_ids)
    packed = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return [shard, block, len(flat), first, nulls, packed.tobytes(), lengths.tobytes(), rules.astype("<u4").tobytes(),
            rule_lengths(rules, first).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(), width]


def encode(docs: DataFrame, vocabulary: str | None = None, per_shard: int = 1024, end: int = tokens.END) -> DataFrame:
    """Blocks of compressed ids (columns of BLOCKS), shards in doc_id order."""
    path = vocabulary or tokens.default_vocabulary()

    def to_ids(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokens.encoder(path)
        kind = "<u2" if max(encoder.size, end + 1) <= 1 << 16 else "<u4"
        stop = np.array([end], kind).tobytes()
        for batch in batches:
            row = 0
            for ids, counts in encoder.chunks(batch.column(2)):
                raw = ids.astype(kind).tobytes()
                ends = (np.cumsum(counts) * int(kind[2])).tolist()
                part = [raw[a:b] + stop for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(row, len(part)) for k in (0, 1)), pa.array(part, pa.binary())], ["doc_id", "shard", "ids"])
                row += len(part)

    def to_blocks(batches):
        encoder = tokens.encoder(path)
        first = max(encoder.size, end + 1)
        kind = "<u2" if first <= 1 << 16 else "<u4"
        schema = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("nulls", pa.int64()),
                            *[(n, pa.binary()) for n in ("doc_ids", "doc_lengths", "rules", "rule_lengths", "symbols")], ("width", pa.int32())])

        def row(*block):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_block_row(*block, first), schema, strict=True)], schema=schema)

        current, number, ids, doc_ids, held = None, 0, [], [], 0
        for batch in batches:
            keys, shards = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, shard, raw in zip(keys, shards, batch.column(2).to_pylist(), strict=True):
                if current is not None and (shard != current or held >= BLOCK):
                    yield row(current, number, ids, doc_ids)
                    number = number + 1 if shard == current else 0
                    ids, doc_ids, held = [], [], 0
                current = shard
                ids.append(np.frombuffer(raw, kind))
                doc_ids.append(key)
                held += len(ids[-1])
        if ids:
            yield row(current, number, ids, doc_ids)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = tokens.sharded(named, per_shard).select("doc_id", "shard", "text").mapInArrow(to_ids, "doc_id long, shard long, ids binary")
    dealt = ids.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return dealt.mapInArrow(to_blocks, BLOCKS)


def decode(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks."""
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    sized = written(blocks.select("shard", "block", "n_tokens"), "sizes")
    shards = sized.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("many", F.floor(F.col("shard") / SHARDS))
    groups = shards.groupBy("many").agg(F.sum("n").alias("m"))  # one row for SHARDS shards
    groups = groups.select("many", so_far("m", before().orderBy("many")).alias("base"))
    shards = shards.join(groups, "many").select("shard", (F.col("base") + so_far("n", before("many").orderBy("shard"))).alias("before"))
    starts = sized.select("shard", "block", so_far("n_tokens", before("shard").orderBy("block")).alias("inside"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("block_start"))

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = expand(np.frombuffer(b["symbols"], f"<u{b['width']}"), np.frombuffer(b["rules"], "<u4").reshape(-1, 2),
                             np.frombuffer(b["rule_lengths"], "<u4").astype(np.int64), b["first"])
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                lengths = np.frombuffer(b["doc_lengths"], "<i8")
                doc_ids = np.frombuffer(b["doc_ids"], "<i8")
                unnamed = np.arange(len(doc_ids)) < b["nulls"]
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=unnamed), pa.array(np.full(len(crc), b["shard"], np.int64)),
                     pa.array(np.full(len(crc), b["block"], np.int32)), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "block", "offset", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(run, "doc_id long, shard long, block int, offset long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (to ``path``, or a new folder in the shared one), read
    them back and digest every document."""
    blocks = encode(docs, **options)
    with small_batches(docs.sparkSession):
        if path is None:
            return decode(written(blocks, "tokens"))
        blocks.write.parquet(path)
        return decode(docs.sparkSession.read.parquet(path))
