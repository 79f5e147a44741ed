"""Token ids of documents, in shards of ascending doc_id.

Tokenising runs in Arrow batches on the executors with the tokenizers library.
``word_bpe_49k.json`` cuts texts at white space and between letters and marks
and folds case.  So texts are cut into words, and plain words (Latin letters,
digits, ASCII marks other than ' and <) into runs of letters, runs of marks and
single digits, by byte classes over whole chunks; equal pieces of a chunk are
found by Arrow's dictionary encoding, only new ones are asked of the library's
model, and the ids of all pieces are put together by one gather.  All other
words go through the library's whole chain as they stand; ``tests/llm`` checks
equality with whole texts.

A Python worker keeps one encoder per vocabulary, which remembers pieces in two
generations bounded in bytes (``CACHE``); a piece is kept when it is new for
the second time (its hash is noted the first time, one byte in a fixed table),
and pieces longer than ``LONGEST`` bytes never are.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb

END = 2  # id appended to each document
CACHE = 64 << 20  # bytes of remembered pieces per worker, both generations
NOTED = 1 << 22  # bytes of the table of hashes that were new once
LONGEST = 200  # bytes of a piece that is remembered
ENTRY = 200  # bytes of an entry beside its piece and ids: two objects and a dict slot
CHUNK = 2 << 20  # bytes of text that are encoded at once
MOST_CUTS = 10_000  # numbers that are broadcast to deal documents to shards

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[b for b in range(0x21, 0x7F)]] = _MARK
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[ord("'"), ord("<")]] = _ODD  # contractions; strings of special tokens
_CLASS[tb.SPACE] = _SPACE
_SECOND = np.zeros(256, bool)  # second bytes, behind 0xC3, of Latin letters
_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_UPPER_SECOND = np.zeros(256, bool)
_UPPER_SECOND[[b for b in range(0x80, 0x9F) if b != 0x97]] = True
_FOLD = tb.FOLD.astype(np.uint8)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(buf: np.ndarray, offs: np.ndarray):
    """Pieces of the texts in buf: (compact bytes, offsets of the pieces,
    whether a piece is plain, number of pieces before each text).  Plain
    pieces are folded to lower case, others stand as in the text."""
    n = len(buf)
    kind = _CLASS[buf]
    folded = _FOLD[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    if len(lead):
        second = buf[lead + 1]
        lead, second = lead[_SECOND[second]], second[_SECOND[second]]
        kind[lead] = kind[lead + 1] = _LETTER
        folded[lead[_UPPER_SECOND[second]] + 1] += 0x20
    keep = kind != _SPACE
    begin = np.empty(n, bool)  # pieces begin where the class changes, and at digits
    begin[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == _DIGIT
    begin[offs[:-1][offs[:-1] < n]] = True
    begin &= keep
    odd_bytes = np.flatnonzero(kind == _ODD)
    odd = np.zeros(0, np.int64)
    if len(odd_bytes):  # words with an odd byte are one piece and stand as they are
        starts, ends = tb.spans(keep, offs)
        word = np.unique(np.searchsorted(starts, odd_bytes, "right") - 1)
        odd, stop = starts[word], ends[word]
        size = stop - odd
        inside = np.repeat(odd - (np.cumsum(size) - size), size) + np.arange(size.sum())
        folded[inside] = buf[inside]
        begin[inside] = False
        begin[odd] = True
    at = np.flatnonzero(begin)
    del kind, begin  # so that the most memory is needed here, not twice as much
    seen = np.cumsum(keep, dtype=np.int32)
    offsets = np.empty(len(at) + 1, np.int32)
    offsets[:-1] = seen[at] - 1
    offsets[-1] = seen[-1] if n else 0
    del seen
    is_plain = np.ones(len(at), bool)
    is_plain[np.searchsorted(at, odd)] = False
    return folded[keep], offsets, is_plain, np.searchsorted(at, offs, "left")


class Encoder:
    """Texts -> ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.model = self.library.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level form of a letter, as the library's own chain makes it
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.once, self.noted = bytearray(NOTED), 0

    def remembered(self) -> int:
        """Bytes that are held at most, by the same count that bounds them."""
        return sum(ENTRY + len(k) + len(v) for part in (self.young, self.old) for k, v in part.items())

    def _keep(self, piece: bytes, ids: bytes) -> None:
        if len(piece) > LONGEST:
            return
        at = hash(piece) % NOTED
        if not self.once[at]:
            self.once[at] = 1
            self.noted += 1
            if self.noted > NOTED // 2:
                self.once, self.noted = bytearray(NOTED), 0
            return
        if self.held > CACHE // 2 - ENTRY - len(piece) - len(ids):
            self.old, self.young, self.held = self.young, {}, 0
        self.young[piece] = ids
        self.held += ENTRY + len(piece) + len(ids)

    def _whole(self, words: list[bytes], plain: bool) -> list[bytes]:
        """Words of any kind, by the library's whole chain."""
        self.library.encode_special_tokens = plain  # special tokens' strings are ordinary text
        found = self.library.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _ids(self, pieces: list[bytes], is_plain: list[bool], plain: bool) -> list[bytes]:
        """Ids of distinct pieces."""
        out = list(map(self.young.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        other = []
        old, tokenize, letters, keep = self.old, self.model.tokenize, self.letters, self._keep
        for k in missing:
            piece = pieces[k]
            ids = old.get(piece)
            if ids is None:
                if not is_plain[k]:
                    other.append(k)
                    continue
                text = piece.decode()
                if not text.isascii():
                    text = text.translate(letters)
                ids = array("I", [t.id for t in tokenize(text)]).tobytes()
            keep(piece, ids)
            out[k] = ids
        if other:
            for k, ids in zip(other, self._whole([pieces[k] for k in other], plain), strict=True):
                out[k] = ids
                if b"<" not in pieces[k]:  # the same whether special tokens are text or not
                    keep(pieces[k], ids)
        return out

    def chunks(self, texts: pa.Array, plain: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids one after another as uint32, number of each text's ids) of the
        texts, some texts at a time; a null text has none."""
        for c in tb.chunks(texts, CHUNK):
            compact, offsets, is_plain, before = _pieces(c.buf, c.offs)
            n = len(offsets) - 1
            if not n:
                yield np.zeros(0, np.uint32), np.zeros(len(c.offs) - 1, np.int64)
                continue
            words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
            coded = words.dictionary_encode()
            del words, compact, offsets
            code = coded.indices.to_numpy()
            of_code = np.zeros(len(coded.dictionary), bool)
            of_code[code] = is_plain  # equal pieces are of one kind
            found = self._ids(coded.dictionary.to_pylist(), of_code.tolist(), plain)
            size = np.fromiter(map(len, found), np.int32, len(found)) >> 2
            flat = np.frombuffer(b"".join(found), "<u4")
            del found
            begin = np.cumsum(size, dtype=np.int32) - size
            length = size[code]
            ends = np.cumsum(length, dtype=np.int32)
            source = np.repeat(begin[code] - (ends - length), length)
            source += np.arange(len(source), dtype=np.int32)
            stops = np.concatenate((np.zeros(1, np.int64), ends))[before]
            yield flat[source], np.diff(stops)

    def each(self, texts: pa.Array, plain: bool = False) -> Iterator[bytes]:
        """The ids of every text, in order, as little-endian uint32."""
        for ids, counts in self.chunks(texts, plain):
            raw, ends = ids.astype("<u4", copy=False).tobytes(), np.cumsum(4 * counts).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                yield raw[a:b]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary, so that what it remembers serves
    all the worker's tasks and no more than one cache is held."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        tb.give_back()  # what reading the vocabulary took
    return _encoders[path]


def _deal(docs: DataFrame, per_shard: int):
    """Cut points of doc_id (a sorted list of MOST_CUTS at most, repeated where
    one id holds several shards' worth of rows) and how many shards lie
    between two of them."""
    rows, some = docs.agg(F.count("*"), F.count("doc_id")).first()
    shards = max(1, -(-rows // per_shard))
    coarse = min(MOST_CUTS, shards)
    cuts: list[int] = []
    if coarse > 1 and some:
        points = [i / coarse for i in range(1, coarse)]
        cuts = docs.agg(F.percentile_approx("doc_id", points, max(10_000, 20 * coarse))).first()[0]
    return sorted(cuts), -(-shards // coarse)


def sharded(docs: DataFrame, per_shard: int = 1024) -> DataFrame:
    """``docs`` (doc_id and more) with shard: shards hold runs of ascending
    doc_id of about ``per_shard`` rows, whatever the number of rows.  Quantiles
    of doc_id cut the ids into at most MOST_CUTS ranges (only these numbers
    come to the driver), and each range is cut evenly by value.  An id that
    holds several shares of all rows has as many shards, filled by the
    partitions its rows lie in."""
    cuts, finer = _deal(docs, per_shard)
    if not cuts:
        return docs.withColumn("shard", F.lit(0).cast("long"))
    distinct = sorted(set(cuts))
    number = Counter(cuts)
    copies = [number[c] if number[c] > 1 else 0 for c in distinct]  # shards of an id's own
    longs = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    # index of the smallest cut that is not below the id, by binary search over a constant array
    at = F.expr(f"""aggregate(sequence(1, {len(distinct).bit_length()}), named_struct('a', 0, 'b', {len(distinct)}),
        (s, i) -> if(s.a >= s.b, s, if(element_at(cuts_, cast((s.a + s.b) div 2 as int) + 1) < doc_id,
            named_struct('a', cast((s.a + s.b) div 2 as int) + 1, 'b', s.b),
            named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)))), s -> s.a)""")
    # shards of the ranges one after another: of each range the values up to its cut, then a frequent cut's own
    first = [0]
    for c in copies:
        first.append(first[-1] + finer + c)
    k = F.col("at_")
    low, high = F.get("cuts_", k - 1).cast("double"), F.get("cuts_", k).cast("double")
    inner = F.floor((F.col("doc_id").cast("double") - low) * finer / (high - low))
    inner = F.when(low.isNull() | high.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(finer - 1), inner)))
    own = F.when(F.get("copies_", k) == 0, finer - 1).otherwise(
        finer + F.pmod(F.spark_partition_id().cast("long"), F.greatest(F.get("copies_", k), F.lit(1).cast("long"))))
    shard = F.get("first_", k) + F.when(F.col("doc_id") == F.get("cuts_", k), own).otherwise(inner)
    named = docs.withColumns({"cuts_": longs(distinct), "copies_": longs(copies), "first_": longs(first)}).withColumn("at_", at)
    return named.withColumn("shard", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(shard).cast("long")).drop("cuts_", "copies_", "first_", "at_")
