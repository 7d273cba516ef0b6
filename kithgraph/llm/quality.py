"""Quality classifier: a convolutional network over bytes, in numpy.

The UTF-8 bytes of a whole text are cut into chunks of CHUNK bytes that overlap by CHUNK - STEP (the
last one ends with the text). In a chunk, learned filters pass over embedded bytes; each filter keeps
its largest answer. Mean, maximum and minimum over the chunks go through one hidden layer to a
probability. Training (Adam, cross-entropy) only passes gradients through the winning positions.

The network is fitted on the driver on all chunks of at most TRAIN_ROWS labelled documents, those of
smallest hash of their doc_id whatever their length; scoring reads every byte of every document in tasks.

Defined cases: null and empty texts are one chunk of padding and get a score; a null label and rows
without a label teach nothing; with no usable label, or only one class, the score is that of the
smoothed base rate; of texts that share a doc_id the smallest teaches; repeated rows are scored each; an empty table gives no rows; other columns are
never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import numbered, table, with_computed

CHUNK, STEP = 256, 224
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
TRAIN_ROWS = 2000
#: Passes over the sample; more of them where it is small, for STEPS_LEAST steps.
EPOCHS = 8
STEPS_LEAST = 250
THRESHOLD = 0.3
FOLDS = 5
_PAD = 256
_BLOCK = 256


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK byte numbers that cover all of ``data``."""
    x = np.frombuffer(data, np.uint8).astype(np.int16)
    if len(x) <= CHUNK:
        return np.pad(x, (0, CHUNK - len(x)), constant_values=_PAD)[None]
    starts = np.append(np.arange(0, len(x) - CHUNK, STEP), len(x) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(x, CHUNK)[starts]


class ByteConv:
    def __init__(self, rate: float, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.rate, self.random = rate, r
        self.p = {
            "embed": normal(_PAD + 1, EMBED, scale=0.5),
            "filter": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "shift": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5),
            "base": np.array([np.log(rate / (1 - rate))], np.float32),
        }
        self.p["embed"][_PAD] = 0

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's largest answer of each filter, and where."""
        e = self.p["embed"][x].reshape(len(x), CHUNK * EMBED)
        seen = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        a = np.ascontiguousarray(seen).reshape(-1, WIDTH * EMBED) @ self.p["filter"]
        a = a.reshape(len(x), -1, FILTERS)
        at = a.argmax(axis=1)
        return np.take_along_axis(a, at[:, None], axis=1)[:, 0] + self.p["bias"], at

    def _head(self, h: np.ndarray, starts: np.ndarray):
        """Document features from the chunks' rectified answers; starts: each document's first chunk."""
        n = np.diff(np.append(starts, len(h)))[:, None]
        d = np.concatenate([np.add.reduceat(h, starts) / n, np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)], axis=1)
        z = np.tanh(d @ self.p["hidden"] + self.p["shift"])
        return d, z, 1 / (1 + np.exp(-(z @ self.p["out"] + self.p["base"][0])))

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows = [chunks(t) for t in texts]
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        x = np.concatenate(rows)
        h = np.concatenate([self._pooled(x[i : i + _BLOCK])[0] for i in range(0, len(x), _BLOCK)])
        return self._head(np.maximum(h, 0), starts)[2].astype(np.float64)

    def _gradients(self, rows: list[np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        starts, x = np.cumsum([0, *map(len, rows)])[:-1], np.concatenate(rows)
        found = [self._pooled(x[i : i + _BLOCK]) for i in range(0, len(x), _BLOCK)]
        raw, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        h = np.maximum(raw, 0)
        d, z, y = self._head(h, starts)
        n, of = np.diff(np.append(starts, len(h))), np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(h))))
        dy = ((y - label) / len(rows)).astype(np.float32)
        g = {"out": z.T @ dy, "base": dy.sum(keepdims=True)}
        dz = dy[:, None] * self.p["out"] * (1 - z * z)
        g |= {"hidden": d.T @ dz, "shift": dz.sum(axis=0)}
        dd = dz @ self.p["hidden"].T
        mean, most, least = dd[:, :FILTERS], dd[:, FILTERS : 2 * FILTERS], dd[:, 2 * FILTERS :]
        dh = (mean / n[:, None])[of]
        for part, best in ((most, d[:, FILTERS : 2 * FILTERS]), (least, d[:, 2 * FILTERS :])):
            hit = h == best[of]
            ties = np.add.reduceat(hit.astype(np.float32), starts)
            dh = dh + hit * (part / ties)[of]
        dh = dh * (raw > 0)
        g["bias"] = dh.sum(axis=0)
        place = at[:, :, None] * STRIDE + np.arange(WIDTH)  # chunk, filter, position in the window
        letters = x[np.arange(len(x))[:, None, None], place]
        seen = self.p["embed"][letters].reshape(len(x), FILTERS, WIDTH * EMBED)
        g["filter"] = np.einsum("cfw,cf->wf", seen, dh)
        de = (dh[:, :, None] * self.p["filter"].T[None]).reshape(-1, EMBED)
        cell = (letters.reshape(-1, 1) * EMBED + np.arange(EMBED)).reshape(-1)
        g["embed"] = np.bincount(cell, de.reshape(-1), (_PAD + 1) * EMBED).reshape(_PAD + 1, EMBED).astype(np.float32)
        g["embed"][_PAD] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, step: float = 3e-3) -> ByteConv:
        rows = [chunks(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        batches = -(-len(rows) // batch)
        epochs = max(epochs, -(-STEPS_LEAST // max(1, batches)))
        total = epochs * batches
        for _ in range(epochs):
            order = self.random.permutation(len(rows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                g, t = self._gradients([rows[j] for j in pick], labels[pick]), t + 1
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= step * (1 - t / (total + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True where crc32 of doc_id as text leaves no remainder; a null doc_id is read as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteConv:
    """A network for P(quality = 1), from labelled documents that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_quality").agg(F.min("text").alias("text"))
    found = sorted(sample.collect(), key=lambda r: r.doc_id)
    y = np.array([r._quality for r in found], np.float32)
    net = ByteConv(float((y.sum() + 1) / (len(y) + 2)))
    if len(set(y.tolist())) < 2:
        net.p["out"][:] = 0
        return net
    return net.fit([r.text.encode("utf-8", "surrogatepass") for r in found], y)


def scores(docs: DataFrame, net: ByteConv, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (none of them named score) and score of every document; a text crosses to Python once."""
    rows = docs.select(*keep, *["text"] * ("text" not in keep))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        out, i = [], 0
        while i < len(texts):  # about a megabyte at a time
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                size += len(texts[j])
                j += 1
            out.append(net.score(texts[i:j]))
            i = j
        return [pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())]

    return with_computed(rows, keep, {"score": T.DoubleType()}, work)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, unchanged."""
    rows, names = numbered(docs)
    return scores(rows, train(docs, labels), names).where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
