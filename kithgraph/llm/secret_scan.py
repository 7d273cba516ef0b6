"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns give the base spans (kinds assign, access, hex). Beside them, every run of key-like
characters long enough to judge is judged, whether a base span holds it or not, if an encoding can be
inferred for it: the smallest of hex, base32, base36, base64 that has its symbols, or letters for a run of
letters in one case. Its symbols, as numbers in the encoding's alphabet, pass three tests of "drawn at
random": chi-squared uniformity over the alphabet, the number of runs above and below the middle, and
serial correlation. Fisher's method joins them to one figure, -log10 p, which is small for random strings.

The hypothesis to be rejected is "ordinary text". How it looks in the battery is learnt from the corpus: every
document's text outside the judged runs, squeezed to the symbols of an alphabet (in the alphabet's case), is
cut from end to end into windows of the bands' lengths, which pass the same tests. Within a stratum of
encoding and length, the p-value of a run is the share of ordinary windows that look as random as it does, and
the Benjamini-Hochberg step-up over all runs judged there gives its q-value. A run outside the base spans
whose q is at most RATE is a span of kind random, so of the random spans of a stratum at most that share is
expected to be ordinary text. A stratum without enough ordinary windows reports nothing. Of base spans the
verdict is only reported; they stay.

The driver sees counts by stratum and step, at most 30 strata of STEP_MOST + 1 steps.

Defined cases: null text is empty; repeated rows are scanned each; ties in the figure share their fate; an
empty table gives no rows; further columns are carried only if asked for, through Arrow and unchanged.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import numbered, table, with_computed, written

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 16
RATE = 0.01
#: -log10 p of the battery is kept in steps of 1 / STEPS; whatever is less random than STEP_MOST counts as that.
STEPS, STEP_MOST = 100, 600
#: Length bands and alphabets.
BANDS = (16, 20, 28, 40, 64, 128)
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
)
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr][Dd]|[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")
_WORD = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*")
_TABLES = [{c: i for i, c in enumerate(letters)} for _, letters in ALPHABETS]
#: Bytes of ordinary text that an alphabet doesn't have, and the case it is read in.
_OTHERS = [bytes(b for b in range(256) if b >= 128 or chr(b) not in letters) for _, letters in ALPHABETS]
_CASES = (bytes.lower, bytes.upper, bytes.lower, bytes, bytes.lower)
_NUMBERS = [np.array([letters.find(chr(b)) for b in range(128)], np.int16) for _, letters in ALPHABETS]
#: Windows that pass the tests at a time.
_BLOCK = 4096


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of start, then kind."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def infer(run: str) -> int | None:
    """The number of the smallest alphabet that holds the run, or None for a word."""
    if _WORD.fullmatch(run):
        return None
    letters = {*run}
    for code, symbols in enumerate(_TABLES):
        if letters <= symbols.keys() or (code in (0, 2) and {*run.lower()} <= symbols.keys() and not any(c.islower() for c in run)):
            return code
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(run: str) -> int | None:
    """As ``infer``, but a run of letters in one case is read in the alphabet of letters."""
    code = infer(run)
    return len(ALPHABETS) - 1 if code is None and run.isascii() and run.isalpha() and _WORD.fullmatch(run) else code


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z."""
    return 0.5 * _erfc(z / math.sqrt(2)).astype(np.float64)


def tests(x: np.ndarray, size: int) -> np.ndarray:
    """p-value of "drawn at random from this alphabet" of each row of symbol numbers, by Fisher's method over the three tests."""
    rows, n = x.shape
    wide = max(size, int(x.max()) + 1) if x.size else size
    counts = np.bincount((np.arange(rows)[:, None] * wide + x).reshape(-1), minlength=rows * wide).reshape(rows, wide).astype(np.float64)
    df = size - 1
    # exact mean and variance of the statistic under a multinomial, for few symbols a cell
    uniform = _tail((np.einsum("ij,ij->i", counts, counts) * size / n - n - df) / math.sqrt(2 * df * (n - 1) / n))
    above = x >= size / 2
    a = above.sum(axis=1)
    b, changes = n - a, (above[:, 1:] != above[:, :-1]).sum(axis=1)
    mean = 2 * a * b / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-12))
    order = np.where((a > 0) & (b > 0), 2 * _tail(np.abs(1 + changes - mean) / spread), 2.0 ** (1 - n))
    centred = x - x.mean(axis=1, keepdims=True)
    power = np.einsum("ij,ij->i", centred, centred)
    product = np.einsum("ij,ij->i", centred[:, 1:], centred[:, :-1])
    serial = np.where(power > 0, 2 * _tail(np.abs(product / np.maximum(power, 1e-12) + 1 / n) * math.sqrt(n)), 2.0 ** (1 - n))
    s = -sum(np.log(np.maximum(p, 1e-100)) for p in (uniform, order, serial))
    return np.exp(-s) * (1 + s + s * s / 2)


def _size(code: int) -> int:
    return 64 if code == 3 else len(ALPHABETS[code][1])


def battery(run: str, code: int) -> float:
    symbols = _TABLES[code]
    return float(tests(np.array([[symbols[c] for c in (run if code in (1, 3) else run.lower())]]), _size(code))[0])


def _steps(p: np.ndarray) -> np.ndarray:
    return np.minimum(-np.log10(np.maximum(p, 1e-90)) * STEPS, STEP_MOST).astype(np.int64)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(stratum, step, start, end, whether a base span holds it) of the judged runs. ``base`` is in order of start, as the runs are: both are walked once."""
    found, k, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        run, (start, end) = m.group(), m.span()
        while k < len(base) and base[k][1] <= start:
            reach, k = max(reach, base[k][2]), k + 1
        code = encoding(run)
        if code is not None:
            band = sum(len(run) >= b for b in BANDS) - 1
            step = int(_steps(np.array([battery(run, code)]))[0])
            found.append((code * len(BANDS) + band, step, start, end, end <= reach))
    return found


def ordinary(texts: list[str]) -> Counter[tuple[int, int]]:
    """(stratum, step) -> windows of ordinary text; the bands' lengths take turns, beginning at a place that the text's length decides."""
    seen: Counter[tuple[int, int]] = Counter()
    plain = [_CANDIDATE.sub("", t).encode("utf-8", "replace") for t in texts]
    for code, (others, case, numbers) in enumerate(zip(_OTHERS, _CASES, _NUMBERS, strict=True)):
        squeezed = [case(t).translate(None, others) for t in plain]
        starts: list[list[int]] = [[] for _ in BANDS]
        before = 0
        for t in squeezed:
            at, left = before, len(t)
            for band in itertools.cycle((*range(left % len(BANDS), len(BANDS)), *range(left % len(BANDS)))):
                if left < SHORTEST:
                    break
                if left >= BANDS[band]:
                    starts[band].append(at)
                    at, left = at + BANDS[band], left - BANDS[band]
            before += len(t)
        x = numbers[np.frombuffer(b"".join(squeezed), np.uint8)]
        for band, places in enumerate(starts):
            for i in range(0, len(places), _BLOCK):
                rows = x[np.array(places[i : i + _BLOCK])[:, None] + np.arange(BANDS[band])]
                for step, n in zip(*np.unique(_steps(tests(rows, _size(code))), return_counts=True), strict=True):
                    seen[code * len(BANDS) + band, int(step)] += int(n)
    return seen


_BASE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")]))
_JUDGED = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("stratum", "step", "start", "end")], T.StructField("inside", T.BooleanType())]))
_ORDINARY = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("stratum", "step")], T.StructField("n", T.LongType())]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (none of them named as the others), base (spans) and candidates of every document, from its whole text.

    Further rows have ``ordinary`` instead, what a batch's ordinary text looks like, and nulls in all other columns.
    """
    rows = docs.select(*keep, *["text"] * ("text" not in keep))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keep)]], T.StructField("base", _BASE), T.StructField("candidates", _JUDGED), T.StructField("ordinary", _ORDINARY)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")]))
        judged = pa.list_(pa.struct([*[(c, pa.int32()) for c in ("stratum", "step", "start", "end")], ("inside", pa.bool_())]))
        counted = pa.list_(pa.struct([("stratum", pa.int32()), ("step", pa.int32()), ("n", pa.int64())]))

        def named(kind, lists):
            return pa.array([[dict(zip([f.name for f in kind.value_type], s, strict=True)) for s in found] for found in lists], kind)

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                kept = [batch.column(c) for c in keep]
                found = [named(span, base), named(judged, map(candidates, texts, base)), pa.nulls(len(texts), counted)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)
                seen = [[(*k, n) for k, n in ordinary(texts).items()]]
                if seen[0]:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, a.type) for a in kept], pa.nulls(1, span), pa.nulls(1, judged), named(counted, seen)], names=schema.names)

    return rows.mapInArrow(run, schema)


def q_values(scanned: DataFrame) -> np.ndarray:
    """q by stratum (row) and step (column), 1 where nothing was judged."""
    shape = (len(ALPHABETS) * len(BANDS), STEP_MOST + 1)

    def counts(column: str, n) -> np.ndarray:
        out = np.zeros(shape)
        for r in scanned.select(F.explode(column).alias("c")).groupBy("c.stratum", "c.step").agg(n.alias("n")).collect():
            out[r.stratum, r.step] = r.n
        return out

    return q_of(counts("candidates", F.count("*")), counts("ordinary", F.sum("c.n")))


def q_of(judged: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg q-values from counts of judged runs and of ordinary windows by stratum and step."""
    p = (1 + plain.cumsum(axis=1)) / (1 + plain.sum(axis=1, keepdims=True))
    rank = judged.cumsum(axis=1)
    raw = np.where(judged > 0, p * rank[:, -1:] / np.maximum(rank, 1), 1.0)
    return np.minimum(np.minimum.accumulate(raw[:, ::-1], axis=1)[:, ::-1], 1.0)


def spans(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents with spans added: base and random ones, sorted by start, then kind; and q, the judged runs' (start, end, q, whether inside a base span). ``scanned`` should be written, as it is read three times."""
    q = q_values(scanned)
    by_step = F.array(*[F.split(F.lit(",".join(f"{x:.4g}" for x in row)), ",").cast("array<double>") for row in q])
    value = lambda c: F.element_at(F.element_at(by_step, c["stratum"] + 1), c["step"] + 1)
    judged = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), value(c).alias("q"), c["inside"].alias("inside")))
    rows = scanned.where(F.col("ordinary").isNull()).drop("ordinary").withColumn("q", judged)
    random = F.transform(F.filter("q", lambda c: ~c["inside"] & (c["q"] <= rate)), lambda c: F.struct(F.lit(3).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    by_start = F.transform(F.array_sort(F.transform(F.concat("base", random), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn("spans", by_start)


def masked(text: str | None, found: list[tuple[int, int]], mark: str) -> str | None:
    """The text with ``mark`` for each (start, end), in order of start; overlapping ones are one."""
    parts, at = [], 0
    for start, end in found:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """The documents with every span's text replaced by ``mark``; overlapping spans are one. n_chars follows. A text is put together once, from its slices."""
    rows, names = numbered(docs)
    found = spans(written(scan(rows, names), "secrets"), rate)
    places = found.select(*names, F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, starts, ends = (batch.column(c).to_pylist() for c in ("text", "starts", "ends"))
        return [pa.array([masked(t, list(zip(a, b, strict=True)), mark) for t, a, b in zip(texts, starts, ends, strict=True)], pa.string()), pa.array([len(a) > 0 for a in starts])]

    rows = with_computed(places, names, {"clean": T.StringType(), "hit": T.BooleanType()}, work).withColumn("text", F.col("clean"))
    if "n_chars" in docs.columns:
        size = names[docs.columns.index("n_chars")]
        rows = rows.withColumn(size, F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    return rows.select(*names).toDF(*docs.columns)


def described(found: DataFrame, rate: float = RATE) -> DataFrame:
    """The query's columns from the result of ``spans``; n_judged counts the judged runs, base_q lists those in base spans as start:end:q."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda all_of: F.array_join(F.transform(all_of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    inside = F.filter("q", lambda c: c["inside"])
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size("q").cast("long").alias("n_judged"),
        F.array_join(F.transform(inside, lambda c: F.concat_ws(":", c["start"], c["end"], c["q"])), ",").alias("base_q"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spans(written(scan(table(spark, sf_dir, "documents")), "secrets")))
