"""Target-distribution importance resampling over a document-by-bucket count matrix that is kept as CSR blocks.

The features of a text are runs of consecutive words, hashed into a fixed number of buckets. Texts are read once: each task
makes blocks of the sparse matrix (row starts, buckets, counts) of bounded size, and the blocks are written to the shared folder. Everything
else reads the blocks: their column sums give the distribution of the documents (and of the target texts), a gain for each bucket follows
from the two, and the product of the matrix with the gains gives each document's weight. With Gumbel noise from a hash of the doc_id the
documents of highest score are a sample without replacement, drawn in proportion to exp(weight / 1000).

The driver sees one number a bucket. Rows are dealt by block, so copies, hot words and very long texts cost what their words cost; a
text is read in slices, and a document has at most as many entries as there are buckets. Blocks are small, as Spark's reader unpacks 4,096
rows of a file at once, whatever they hold: a document of more entries than a block comes in parts, whose sums are added by its row number.
Ranks come from a range sort, not from one window.

Defined cases: a null or empty text, and one without words, has no features and weight 0; rows without doc_id are counted in all sums but have no
score, take no part in the draw, nor in the number of documents it is a share of; repeated rows are documents of their own (equal
scores and ids in any order); without target texts all gains follow from the documents alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import table, written
from kithgraph.operators.ranking import placed

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: A block has at most so many rows and entries; each part of a longer document is a block of its own.
BLOCK_ROWS, BLOCK_ENTRIES = 128, 512
#: Blocks go from and through Python in batches of about so many documents or entries, and so many blocks.
SENT_ROWS, SENT_ENTRIES, SENT_BLOCKS = 1 << 13, 1 << 16, 128
#: A text is read in slices of about so many bytes.
SLICE = 1 << 20
#: Words kept with their buckets by a Python worker, at most; further ones are hashed each time.
KEPT = 200_000

#: What stands between words becomes a space; A-Z become small. Bytes from 0x80 up are parts of letters.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """feature -> bucket, filled on first sight."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < KEPT and len(feature) < 64:
            self[feature] = bucket
        return bucket


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def counts(text: bytes | None, bucket: _Buckets, longest: int = LONGEST) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a UTF-8 text, and its buckets in order with the number of features in each."""
    words, before, found, sums = 0, [], np.empty(0, np.int64), None
    for part in _slices((text or b"").translate(_PLAIN)):
        here = part.split()
        words += len(here)
        features = here
        if longest > 1:
            run = before + here
            features = list(here)
            for n in range(2, longest + 1):
                features += [b" ".join(run[i - n + 1 : i + 1]) for i in range(max(len(before), n - 1), len(run))]
            before = run[-(longest - 1) :]
        if len(found):  # a further slice
            sums = np.zeros(bucket.buckets, np.int64) if sums is None else sums
            sums += np.bincount(found, minlength=bucket.buckets)
        found = np.fromiter(map(bucket.__getitem__, features), np.int64, len(features))
    if sums is None:
        return words, *np.unique(found, return_counts=True)
    sums += np.bincount(found, minlength=bucket.buckets)
    buckets = np.flatnonzero(sums)
    return words, buckets, sums[buckets]


#: A text has under 2^31 bytes, so under 2^30 words: counts of its entries are ints.
BLOCK = "first long, part boolean, doc_id array<long>, words array<long>, starts array<int>, buckets array<int>, counts array<int>"

#: Row number, whether this is a part of the document, doc_id, words, buckets, counts.
_Doc = tuple[int, bool, int | None, int, np.ndarray, np.ndarray]


def _documents(batches: Iterator[pa.RecordBatch], bucket: _Buckets, longest: int) -> Iterator[_Doc]:
    """Documents in order, longer ones in parts; the first part has the words."""
    for batch in batches:
        for row, owner, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            n, where, many = counts(text.as_py(), bucket, longest)
            for at in range(0, max(len(where), 1), BLOCK_ENTRIES):
                yield row, len(where) > BLOCK_ENTRIES, owner, 0 if at else n, where[at : at + BLOCK_ENTRIES], many[at : at + BLOCK_ENTRIES]


def _blocks(docs: list[_Doc], cuts: list[int]) -> pa.RecordBatch:
    """One row for each block; blocks begin at ``cuts``."""
    row, part, owner, words, where, many = zip(*docs, strict=True)
    at, ends = np.array([*cuts, len(docs)]), np.cumsum([0, *map(len, where)])
    lists = [
        (pa.array(owner, pa.int64()), at),
        (pa.array(words, pa.int64()), at),
        (pa.array(np.concatenate([ends[a : b + 1] - ends[a] for a, b in pairwise(at)]), pa.int32()), at + np.arange(len(at))),
        (pa.array(np.concatenate(where), pa.int32()), ends[at]),
        (pa.array(np.concatenate(many), pa.int32()), ends[at]),
    ]
    made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for values, offsets in lists]
    return pa.RecordBatch.from_arrays([pa.array([row[c] for c in cuts], pa.int64()), pa.array([part[c] for c in cuts], pa.bool_()), *made], names=["first", "part", "doc_id", "words", "starts", "buckets", "counts"])


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Blocks of the matrix: the first row's number (the others follow it), whether the block is a part of one document, doc_id and words of
    each row, the places where rows start (and the end), and buckets and counts of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, cuts, held, width = [], [], 0, 0
        for doc in _documents(batches, _Buckets(buckets), longest):
            size = len(doc[4])
            if not cuts or doc[1] or found[-1][1] or len(found) - cuts[-1] >= BLOCK_ROWS or width + size > BLOCK_ENTRIES:
                if held >= SENT_ENTRIES or len(found) >= SENT_ROWS:
                    yield _blocks(found, cuts)
                    found, cuts, held = [], [], 0
                cuts.append(len(found))
                width = 0
            found.append(doc)
            held, width = held + size, width + size
        if found:
            yield _blocks(found, cuts)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket: a task sends one row for each bucket it has seen, the driver gets one for each bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "n": pa.array(sums[seen])})

    total = [0] * buckets
    for row in blocks.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return np.array(total, np.int64)


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier each bucket is in the target, with one more feature in each bucket on both sides, rounded down."""
    here, there, k = int(documents.sum()), int(target.sum()), len(documents)
    ratio = [float(t + 1) * float(here + k) / (float(s + 1) * float(there + k)) for s, t in zip(documents.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, part, doc_id, words, n_features, weight: the product of the matrix with the gains, for each document or part of one."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SENT_BLOCKS):
                some = batch.slice(k, SENT_BLOCKS)
                owner, words, starts, where, many = (some.column(c) for c in ("doc_id", "words", "starts", "buckets", "counts"))
                here, entries = owner.value_lengths().to_numpy(), where.value_lengths().to_numpy()
                places = starts.flatten().to_numpy() + np.repeat(np.cumsum(entries) - entries, here + 1)
                between = np.cumsum(here + 1)[:-1] - 1  # from a block's end to the next one's start
                many = many.flatten().to_numpy()
                totals = [np.delete(np.diff(np.concatenate(([0], np.cumsum(x)))[places]), between) for x in (many, many * gain[where.flatten().to_numpy()])]
                row = np.repeat(some.column("first").to_numpy() - (np.cumsum(here) - here), here) + np.arange(here.sum())
                part = np.repeat(some.column("part").to_numpy(zero_copy_only=False), here)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(part), owner.flatten(), words.flatten(), *map(pa.array, totals)], names=["row", "part", "doc_id", "words", "n_features", "weight"])

    return blocks.mapInArrow(product, "row long, part boolean, doc_id long, words long, n_features long, weight long")


def whole(found: DataFrame) -> DataFrame:
    """row, doc_id, words, n_features, weight of each document: what came in parts is added up."""
    sums = ("words", "n_features", "weight")
    parts = found.where("part").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums])
    return found.where("NOT part").select("row", "doc_id", *sums).unionByName(parts)


def noisy(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight and Gumbel noise from the doc_id's hash, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every row of ``docs`` (doc_id, text), for ``target`` texts (text)."""
    blocks = written(csr_blocks(docs, buckets, longest), "csr-blocks")
    aim = column_sums(csr_blocks(target.select(F.lit(None).alias("doc_id"), "text"), buckets, longest), buckets)
    found = written(weights(blocks, gains(column_sums(blocks, buckets), aim)), "weights")
    rows = written(whole(found).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), "scores")
    in_draw = (F.col("words") >= least_words) & F.col("score").isNotNull()
    ranked = placed(rows.where(in_draw), F.desc("score"), F.asc("doc_id"), F.asc("row"), out="rank")
    drawn = rows.where(in_draw).count() * percent // 100
    rest = rows.where(~in_draw).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))


_SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"  # fixed value: the polynomial of CRC-32
ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_STEP} FROM steps WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, true AS own, doc_id, regexp_extract_all({_LOWER}, '{_SPLIT}') AS words FROM documents
  UNION ALL SELECT NULL, false, NULL, regexp_extract_all({_LOWER}, '{_SPLIT}') FROM benchmark
), features AS MATERIALIZED (SELECT rid, own, word, count(*) AS n FROM (SELECT rid, own, unnest(words) AS word FROM texts) GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM features)),
hashed AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST(('0x' || substring(h, 2 * i - 1, 2)) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) % {BUCKETS} AS bucket
  FROM vocabulary, crc_table
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM sums) + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM sums) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM sums
), weighed AS (
  SELECT rid, sum(n) AS n, sum(n * g) AS w FROM features JOIN hashed USING (word) JOIN gain USING (bucket) WHERE own GROUP BY rid
), scored AS (
  SELECT d.rid, d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight,
    CAST(coalesce(w, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substring(sha256('{SEED}:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts d LEFT JOIN weighed USING (rid) WHERE own
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS} AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""
