"""Token counts by a separator scan (operator 9).

Token files are flat: ids of fixed width one after another, every document
closed by the end-of-document id, no index.  Files are read as blocks of a
fixed number of ids, so documents straddle blocks (and files, where a file
does not end on the separator).  Each block is searched at once for the
separator; it yields its number of ids and the places of its separators.  A
prefix scan over the blocks, first inside each file, then over the files,
gives every block the position at which it begins, the number of documents
that ended before it and where the last one ended.  From these follow the
start and length of every document.

An empty file yields nothing; ids after the last separator are one open
document (``closed`` false); two separators in a row are an empty document of
one token, its end id; a null or empty text is such a document; null doc_ids
and repeated rows are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm import tokens
from storepulse.llm.common import written

IDS = 1 << 18  # ids of a block
END = 49407  # <|endoftext|> of the default vocabulary, which no text yields


def flat_blocks(docs: DataFrame, vocabulary: str | None = None, end: int = END, block_ids: int = IDS) -> DataFrame:
    """Tokenise documents into flat blocks: file (number of the task), block,
    ids (binary), width, and the doc_ids of the documents that begin in it."""
    path = vocabulary or tokens.default_vocabulary()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokens.encoder(path)
        width = 2 if max(encoder.size, end + 1) <= 1 << 16 else 4
        file = TaskContext.get().partitionId()
        held, size, names, block = [], 0, [], 0

        def row(ids, names):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([width], pa.int32()), pa.array([names], pa.list_(pa.int64()))], ["file", "block", "ids", "width", "names"])

        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.chunks(batch.column(1), plain=True):
                stops = np.cumsum(counts)
                flat = np.insert(ids, stops, end).astype(f"<u{width}")  # the separator behind every text
                starts = stops - counts + np.arange(len(counts)) + size  # in the ids held and these
                held.append(flat)
                size += len(flat)
                if size >= block_ids:
                    whole = np.concatenate(held)
                    full = len(whole) // block_ids
                    of_block = np.searchsorted(starts, np.arange(1, full + 1) * block_ids).tolist()
                    for k, (a, b) in enumerate(zip([0, *of_block], of_block, strict=False)):
                        yield row(whole[k * block_ids:(k + 1) * block_ids], names + keys[done + a:done + b])
                        names, block = [], block + 1
                    held, size = [whole[full * block_ids:].copy()], len(whole) - full * block_ids
                    names = keys[done + of_block[-1]:done + len(counts)]
                else:
                    names += keys[done:done + len(counts)]
                done += len(counts)
        if size:
            yield row(np.concatenate(held), names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "file long, block long, ids binary, width int, names array<bigint>")


def file_blocks(spark: SparkSession, path: str, width: int = 4, block_ids: int = IDS) -> DataFrame:
    """Blocks of raw token files (each file small enough for one row; the
    files follow one another by path)."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    step = width * block_ids
    cut = files.select("path", F.posexplode(F.transform(
        F.sequence(F.lit(0), (F.length("content") - 1).cast("int"), F.lit(step)),
        lambda i: F.substring(F.col("content"), i + 1, F.lit(step)))).alias("block", "ids"))
    return cut.select(F.col("path").alias("file"), F.col("block").cast("long").alias("block"), "ids", F.lit(width).alias("width"))


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """file, ordinal (in its file), position (among all documents), start,
    n_tokens (with the separator) and closed of every document."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            n, last, ends = [], [], []
            for raw, width in zip(batch.column(names.index("ids")), batch.column(names.index("width")).to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                last.append(int(at[-1]) if len(at) else None)
                ends.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("file")), batch.column(names.index("block")), pa.array(n, pa.int64()),
                 pa.array(last, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "last", "ends"])

    kind = dict(blocks.dtypes)["file"]
    found = written(blocks.select("file", "block", "ids", "width").mapInArrow(
        run, f"file {kind}, block long, n long, last long, ends array<bigint>"), "separators")

    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = found.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    b = b.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(inside), F.lit(0)))
    b = b.withColumn("closed_at", F.max(F.col("at") + F.col("last")).over(inside))
    files = found.groupBy("file").agg(F.sum("n").alias("f_n"), F.sum(F.size("ends")).alias("f_docs"))
    ended = b.groupBy("file").agg(F.max(F.col("at") + F.col("last")).alias("f_last"))
    across = Window.partitionBy().orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.join(ended, "file").withColumn("f_at", F.coalesce(F.sum("f_n").over(across), F.lit(0)))
    files = files.withColumn("f_before", F.coalesce(F.sum("f_docs").over(across), F.lit(0)))
    files = files.withColumn("f_closed", F.max(F.col("f_at") + F.col("f_last")).over(across))
    files = written(files, "files")
    whole = b.join(files, "file")
    previous = F.coalesce(F.col("f_at") + F.col("closed_at"), F.col("f_closed"), F.lit(-1))
    one = whole.select(
        "file", "docs", "f_before", previous.alias("previous"),
        F.transform("ends", lambda e: e + F.col("f_at") + F.col("at")).alias("ends"))
    one = one.select("file", "docs", "f_before", "ends", F.concat(F.array("previous"), "ends").alias("starts"))
    docs = one.select("file", "docs", "f_before", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "z")).where("z.ends IS NOT NULL")
    closed = docs.select(
        "file", (F.col("docs") + F.col("k")).alias("ordinal"), (F.col("f_before") + F.col("docs") + F.col("k")).alias("position"),
        (F.col("z.starts") + 1).alias("start"), (F.col("z.ends") - F.col("z.starts")).alias("n_tokens"), F.lit(True).alias("closed"))
    total = files.agg(F.sum("f_n").alias("n"), F.max(F.col("f_at") + F.col("f_last")).alias("last"),
                      F.sum("f_docs").alias("docs"), F.max(F.struct("f_at", "file", "f_docs")).alias("f"))
    rest = total.where("n > coalesce(last, -1) + 1").select(
        F.col("f.file").alias("file"), F.col("f.f_docs").alias("ordinal"), F.col("docs").alias("position"),
        (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise documents to flat blocks, write them, scan them, and name the
    documents again by their order: doc_id, file, position, start, n_tokens."""
    blocks = written(flat_blocks(docs, **options), "flat")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = blocks.select("file", "block", "names").withColumn("before", F.coalesce(F.sum(F.size("names")).over(before), F.lit(0)))
    names = names.select("file", "before", F.posexplode("names").alias("k", "doc_id")).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"), "doc_id")
    return scan(blocks, options.get("end", END)).join(names, ["file", "ordinal"]).select(
        "doc_id", "file", "position", "start", "n_tokens")
