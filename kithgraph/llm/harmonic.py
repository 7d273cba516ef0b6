"""Harmonic packing: pieces in reciprocal-capacity classes, and bins of one class that hold a fixed number of pieces.

A class holds pieces of the one length floor(capacity / k) that k of them fill a bin with, up to SLACK tokens; only classes that fill it
so far are used, and every power of two up to the capacity is one of them. Documents may be cut anywhere, so each is cut into whole bins and
then the fewest pieces of class lengths, the longest first. A worker keeps one open bin a class, bounded by the number of classes
times the capacity, and closes it at its k-th piece: workers fill their bins without a word to each other.

At its end a worker cuts its open bins' pieces into powers of two, which go to those classes, and what still doesn't fill a bin is
left to a second step, which numbers the pieces of each class over all workers by prefix sums and deals k to a bin again. Of
each class fewer than k pieces remain, over the whole table; they are dealt in groups whose number is a power of two, so such a sequence's
length is one too and needs no padding. Padding is therefore at most SLACK tokens a sequence, in tables of any size.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own; rows without doc_id are packed like
others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import table, with_bucket_offsets, written
from kithgraph.llm.token_ids import encoder, vocabulary

CAPACITY = 2048
END_ID = 1
#: Tokens that a full bin of a class may lack.
SLACK = 2


def class_lengths(capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """The lengths of pieces, longest first; floor(capacity / length) of them fill a bin up to ``slack``."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    return [n for n in range(capacity, 0, -1) if capacity % n <= slack]


def fewest_pieces(capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, ...]]:
    """For each length below the capacity the fewest class lengths with that sum, longest first."""
    lengths, best = class_lengths(capacity, slack), [()]
    for total in range(1, capacity):
        best.append(min(((n, *best[total - n]) for n in lengths if n <= total), key=lambda cut: (len(cut), [-n for n in cut])))
    return [tuple(sorted(cut, reverse=True)) for cut in best]


class Filler:
    """One worker's open bins. A piece is (doc_id, start, crc, doc_tokens, its ids if it may be cut again)."""

    COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def __init__(self, worker: int, capacity: int, cuts: list[tuple[int, ...]], lengths: list[int]):
        self.capacity, self.cuts, self.open = capacity, cuts, {n: [] for n in lengths}
        self.next_id, self.out = worker << 40, {c: [] for c in self.COLUMNS}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data, total, at = ids.astype("<u4", copy=False).tobytes(), len(ids), 0
        whole = total // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._close(self.capacity, [(doc_id, at, zlib.crc32(data[4 * at : 4 * (at + self.capacity)]), total)])
        at = whole
        for n in self.cuts[total - whole]:
            piece = data[4 * at : 4 * (at + n)]
            self._put(n, (doc_id, at, zlib.crc32(piece), total, piece if n & (n - 1) else b""))
            at += n

    def _put(self, n: int, piece: tuple) -> None:
        waiting = self.open[n]
        waiting.append(piece)
        if len(waiting) == self.capacity // n:
            self._close(n, waiting)
            waiting.clear()

    def _close(self, n: int, pieces: list[tuple]) -> None:
        out, k = self.out, len(pieces)
        for column, place in (("doc_id", 0), ("start", 1), ("ids_crc32", 2), ("doc_tokens", 3)):
            out[column] += [p[place] for p in pieces]
        out["length"] += [n] * k
        out["sequence_id"] += [self.next_id] * k
        out["offset"] += range(0, n * k, n)
        self.next_id += 1

    def end(self) -> None:
        """Pieces of other lengths are cut into powers of two; what fills no bin goes out without a sequence, numbered by length."""
        for n in [n for n in self.open if n & (n - 1)]:
            waiting, self.open[n] = self.open[n], []
            for doc_id, start, _, total, data in waiting:
                at = 0
                while at < n:
                    size = 1 << (n - at).bit_length() - 1
                    part = data[4 * at : 4 * (at + size)]
                    self._put(size, (doc_id, start + at, zlib.crc32(part), total, b""))
                    at += size
        for n, waiting in self.open.items():
            first = len(self.out["offset"])
            self._close(n, waiting)
            self.out["sequence_id"][first:] = [None] * len(waiting)
            self.out["offset"][first:] = range(len(waiting))

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({c: pa.array(self.out[c], kind) for c, kind in self.COLUMNS.items()})
        self.out = {c: [] for c in self.COLUMNS}
        return made


def filled(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """The pieces of every document, with worker; those that filled no bin of their worker have no sequence_id, and their number among the worker's of that length as offset."""
    name, cuts, lengths = tokenizer or vocabulary(), fewest_pieces(capacity, slack), class_lengths(capacity, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(name), TaskContext.get().partitionId()
        filler = Filler(worker, capacity, cuts, lengths)
        made = lambda batch: batch.append_column("worker", pa.array(np.full(batch.num_rows, worker, np.int32)))
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                filler.add(doc_id, np.append(encode(text), np.array(end_id).astype("<u4")))
                if len(filler.out["offset"]) > 1 << 16:
                    yield made(filler.batch())
        filler.end()
        yield made(filler.batch())

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)


def merged(loose: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of the pieces (of power-of-two lengths) that filled no bin of their worker: k to a bin, then groups of a power of two."""
    rows = loose.drop("sequence_id").withColumnRenamed("offset", "within").withColumn("one", F.lit(1))
    rows = with_bucket_offsets(rows, ["length"], "worker", "one", "before")
    sizes = loose.groupBy(F.col("length").alias("of")).agg(F.count("*").alias("n"))  # a row a power of two
    rows = rows.join(F.broadcast(sizes), F.col("length") == F.col("of"))
    at, k = F.col("before") + F.col("within"), (F.lit(capacity) / F.col("length")).cast("long")
    rows = rows.withColumns({"at": at, "k": k}).withColumns({"bin": F.floor(F.col("at") / F.col("k")), "i": F.col("at") % F.col("k"), "left": F.col("n") % F.col("k")})
    in_bin = F.col("bin") < F.floor(F.col("n") / F.col("k"))
    group, first = F.lit(0), F.lit(0).cast("long")
    for j in range(capacity.bit_length() - 1):  # the largest power of two whose group reaches so far, last
        upto = F.shiftleft(F.shiftright("left", j), j)
        group = F.when(F.col("i") < upto, F.lit(j + 1)).otherwise(group)
        first = F.when(F.col("i") < upto, F.shiftleft(F.shiftright("left", j + 1), j + 1)).otherwise(first)
    number = -1 - (F.col("length") * (1 << 44) + F.col("bin") * 64 + F.when(in_bin, 0).otherwise(group))
    offset = F.when(in_bin, F.col("i")).otherwise(F.col("i") - first) * F.col("length")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **settings) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = written(filled(docs, capacity=capacity, **settings), "harmonic")
    return rows.where(F.col("sequence_id").isNotNull()).drop("worker").unionByName(merged(rows.where(F.col("sequence_id").isNull()), capacity))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
