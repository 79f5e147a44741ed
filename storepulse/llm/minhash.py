"""MinHash near-duplicate detection (operator 2).

One-permutation hashing: a document's shingle hashes are sorted once, and the
smallest hash in each of ``bands * rows`` equal bins of the hash range is its
signature.  Empty bins are filled by optimal densification: every bin has its
own random order of all bins and takes the value of the first non-empty one.
Bands of ``rows`` values are the bucket keys.

Exact copies (equal shingle sets) are collapsed first.  Inside a bucket a star
bounds the candidate pairs: only the member with the most company in all its
buckets (the hub) is paired with the others, and every candidate is confirmed
on the full shingle sets.  A star alone may lose a link between two members of
which one is too far from the hub.  So each comparison with a hub h that has
several partners also keeps what x lacks of h (M) and has beyond h (R), and
the members outside the hub's component are compared with the others by

    |x & y| = |h| - |M_x| - |M_y| + |M_x & M_y| + |R_x & R_y|,

exactly, from these short differences alone and in blocks that hold a bounded
number of x.  Only confirmed links leave a block; no pairs are emitted.

Null or empty texts have an empty set and are linked with nothing; of rows that
repeat a doc_id each is judged by its own text; a null doc_id is never linked
and is kept; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import textbytes as tb
from storepulse.llm.common import written

SHARE = 128  # members of a star that are confirmed in one group
OUTSIDE = 512  # members outside a hub's component that a block holds
OTHERS = 2048  # members that are compared with a block in one group
FILTER = 1 << 18  # 64-bit words of the id filter: 2 MB, whatever the number of ids


def shingle_sets(texts: pa.Array, size: int):
    """(row, sorted distinct 64-bit shingle hashes) of each text."""
    for c in tb.chunks(texts):
        starts, ends = tb.spans(tb.NOT_SPACE[c.buf], c.offs)
        words = tb.span_hashes(c.buf, starts, ends, tb.BYTE_VALUE_FOLDED)
        grams = tb.window_hashes(words, size)
        at = tb.per_document(starts, c.offs)
        for i in range(len(c.offs) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield c.first + i, np.unique(grams[a:b - size + 1])
            elif b > a:  # fewer words: the whole sequence is one shingle
                yield c.first + i, tb.window_hashes(words[a:b], b - a)
            else:
                yield c.first + i, grams[:0]


def densify_order(bins: int) -> np.ndarray:
    rng = np.random.default_rng(977)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(s: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One value per bin of a non-empty sorted set."""
    width = (1 << 64) // bins + 1
    edges = np.array([i * width for i in range(bins)], np.uint64)
    first = np.searchsorted(s, edges)
    last = np.append(first[1:], len(s))
    full = last > first
    values = s[np.minimum(first, len(s) - 1)]
    if full.all():
        return values
    empty = np.flatnonzero(~full)
    values[empty] = values[order[empty, full[order[empty]].argmax(axis=1)]]
    return values


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int, least: int) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the set) and the bucket keys (none
    for a set of fewer than ``least`` shingles)."""

    def run(batches):
        order = densify_order(bands * rows)
        for batch in batches:
            n, fp, keys = [], [], []
            for _, s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s) >= least:
                    v = signature(s, bands * rows, order).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
                    for j in range(rows):
                        key = tb.mix(key * np.uint64(0xD6E8FEB86659FD93) + v[:, j])
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "n_shingles", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, fp binary, keys array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b, linked, n = |A| of every pair, compared on the full sets, and
    where a has several partners lacks = A - B and extra = B - A.  A centre's
    set is held once for each group of about SHARE partners."""
    load = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    dealt = pairs.join(load, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / SHARE).cast("int")).alias("share"), "b", (F.col("partners") > 1).alias("several"))
    heads = dealt.select("a", "share").distinct().select("a", "share", F.col("a").alias("b"), F.lit(False).alias("several"))
    rows = (dealt.union(heads).join(texts, F.col("b") == F.col("doc_id"))
            .select("a", "share", (F.col("a") != F.col("b")).alias("partner"), "b", "several", "text")
            .repartition("a", "share").sortWithinPartitions("a", "share", "partner"))

    def run(batches):
        current, heads = None, []
        for batch in batches:
            a, share, partner, b, several = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i, s in shingle_sets(batch.column(5), shingle):
                if (a[i], share[i]) != current:
                    current, heads = (a[i], share[i]), []
                if not partner[i]:
                    heads.append(s)
                    continue
                for h in heads:
                    there = h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s
                    both = int(there.sum())
                    linked = 100 * both >= percent * (len(s) + len(h) - both)
                    lacks = extra = None
                    if several[i]:
                        lacks = np.setdiff1d(h, s, assume_unique=True).view(np.int64)
                        extra = s[~there].view(np.int64)
                    out.append((a[i], b[i], linked, len(h), lacks, extra))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "linked", "n", "lacks", "extra"])

    return rows.mapInArrow(run, "a long, b long, linked boolean, n long, lacks array<bigint>, extra array<bigint>")


class Block:
    """Members outside a hub's component, indexed by what they lack and have."""

    def __init__(self):
        self.ids, self.components, self.sizes, self.parts = [], [], [], ([], [])
        self.ready = False

    def add(self, id_, component, size, lacks, extra):
        for part, grams in zip(self.parts, (lacks, extra), strict=True):
            part.append(grams)
        self.ids.append(id_)
        self.components.append(component)
        self.sizes.append(size)

    def close(self):
        self.index = []
        for part in self.parts:
            grams = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
            order = np.argsort(grams, kind="stable")
            self.index.append((grams[order], owner[order]))
        self.ids, self.components, self.sizes = (np.array(v, np.int64) for v in (self.ids, self.components, self.sizes))
        self.lacking = np.array([len(p) for p in self.parts[0]], np.int64)
        self.ready = True

    def shared(self, which: int, grams: np.ndarray) -> np.ndarray:
        """With each member, how many of the grams it shares."""
        keys, owner = self.index[which]
        first, last = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
        n = last - first
        if not n.any():
            return np.zeros(len(self.ids), np.int64)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(self.ids))

    def linked(self, hub: int, component: int, lacks: np.ndarray, extra: np.ndarray, percent: int) -> np.ndarray:
        size = hub - len(lacks) + len(extra)
        both = hub - self.lacking - len(lacks) + self.shared(0, lacks) + self.shared(1, extra)
        return self.ids[(100 * both >= percent * (self.sizes + size - both)) & (self.components != component)]


def stragglers(compared: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a star, one of them outside the hub's
    component, the other in any other component."""
    of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    known = compared.where("lacks IS NOT NULL").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        "a", "b", "n", "lacks", "extra", F.coalesce("a_component", "a").alias("own"), F.coalesce("b_component", "b").alias("component"))
    known = written(known, "known")
    counts = known.groupBy("a").agg(F.ceil(F.count_if(F.col("component") != F.col("own")) / OUTSIDE).cast("int").alias("blocks"),
                                    F.ceil(F.count("*") / OTHERS).cast("int").alias("parts")).where("blocks > 0")
    rows = known.join(counts, "a")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    cols = ["n", "b", "component", "lacks", "extra"]
    outside = rows.where("component <> own").select("a", mine("blocks").alias("block"), upto("parts").alias("part"), F.lit(0).alias("other"), *cols)
    others = rows.select("a", upto("blocks").alias("block"), mine("parts").alias("part"), F.lit(1).alias("other"), *cols)
    dealt = outside.union(others).repartition("a", "block", "part").sortWithinPartitions("a", "block", "part", "other")

    def run(batches):
        current, block = None, Block()
        for batch in batches:
            a, blocks, parts, other, n, b, component = (batch.column(i).to_pylist() for i in range(7))
            grams = []
            for i in (7, 8):
                column = batch.column(i)
                grams.append((column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)))
            out_a, out_b = [], []
            for i in range(len(a)):
                if (a[i], blocks[i], parts[i]) != current:
                    current, block = (a[i], blocks[i], parts[i]), Block()
                lacks, extra = (values[offsets[i]:offsets[i + 1]] for offsets, values in grams)
                if not other[i]:
                    block.add(b[i], component[i], n[i] - len(lacks) + len(extra), lacks, extra)
                    continue
                if not block.ready:
                    if not block.ids:
                        continue
                    block.close()
                for x in block.linked(n[i], component[i], lacks, extra, percent).tolist():
                    out_a.append(min(x, b[i]))
                    out_b.append(max(x, b[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def marked(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs with a boolean column ``name``: false only for rows whose doc_id is
    certainly not in ``ids`` (id).  A bit map of the hashed ids, of fixed size,
    is broadcast, so no row is shuffled for it."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER))
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    words = ids.select(bit("id").alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask(F.col("bit"))).alias("mask"))
    dense = docs.sparkSession.range(FILTER).join(words, F.col("id") == F.col("word"), "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("m")))), lambda w: w["m"]).alias("words_"))
    own = bit(F.col("doc_id").cast("long"))
    here = F.element_at("words_", (own / 64).cast("int") + 1).bitwiseAND(mask(own)) != 0
    return docs.crossJoin(F.broadcast(dense)).withColumn(name, here).drop("words_")  # one row


def found(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with a boolean column found_: doc_id is in ``ids`` (distinct id).
    An outer join, since Spark moves a semi or anti join below the filter on
    the bit map and then shuffles every text."""
    flagged = ids.select(F.col("id").alias("doc_id"), F.lit(True).alias("found_"))
    return docs.join(flagged, "doc_id", "left").withColumn("found_", F.coalesce("found_", F.lit(False)))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (distinct id).  Only the
    texts that ``marked`` lets through are shuffled for the exact join, not the
    whole corpus."""
    rows = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "here_").where("here_")
    return found(rows, ids).where("found_").select("doc_id", "text")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that are not in ``ids`` (distinct id); as in ``texts_of``
    only the rows that may be are shuffled."""
    rows = marked(docs, ids, "here_")
    maybe = found(rows.where("here_"), ids).where("NOT found_")
    return rows.where("NOT here_").select(docs.columns).unionByName(maybe.select(docs.columns))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in ``links`` (a, b),
    by alternating large-star and small-star steps until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        edges = written(small, "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = mark


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per input row.

    Linked are documents with 100 * |A & B| >= percent * |A | B|; with 24
    bands of 5 a pair at 85 % shares no bucket with probability below 1e-6.
    """
    least = -(-percent // max(1, 100 - percent))  # smaller sets can only equal each other
    sk = written(sketch(docs, shingle, bands, rows, least), "sketch")
    classes = written(sk.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "classes")
    member = classes.select(F.explode("keys").alias("key"), "id")
    crowd = member.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    member = written(member.join(crowd, "key"), "buckets")
    company = member.groupBy("id").agg(F.sum("crowd").alias("company"))
    member = written(member.join(company, "id").select("key", "id", "company"), "buckets")
    texts = written(texts_of(docs, written(member.select("id").distinct(), "ids")), "texts")

    hubs = member.groupBy("key").agg((-F.max(F.struct("company", (-F.col("id")).alias("minus")))["minus"]).alias("hub"))
    pairs = written(member.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    compared = written(confirm(pairs, texts, shingle, percent), "compared")
    links = compared.where("linked").select("a", "b")
    links = links.union(written(stragglers(compared, components(links), percent), "links"))
    label = written(components(links), "components")
    of_class = classes.select("fp", "id").join(label, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    linked = (sk.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "fp").join(of_class, "fp")
              .select("doc_id", "n_shingles", F.col("component").alias("component_id")))
    alone = sk.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that repeat another: of each group of
    near-duplicates the one with the smallest doc_id stays."""
    judged = written(near_duplicates(docs, **options), "judged")
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("some")).where("NOT some").select(F.col("doc_id").alias("id"))
    out = without(docs, written(gone, "gone"))
    again = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = written(again, "again")  # repeated rows: one of each id and text stays
    return out.join(again, "doc_id", "left_anti").unionByName(
        out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
