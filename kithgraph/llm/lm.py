"""Language-model scoring by a gated recurrent network in numpy with a class-factored output.

Counts. Every training token (ASCII-lower-cased words, and an end after each document) is counted in
Spark. The most frequent words, RANKED at most, go to the tasks with their counts; the counts of all others
reach the documents through a join on the word.

Model. The WORDS most frequent words are outputs of their own, in classes of CLASS by frequency:
P(word) = P(class | state) P(word | class, state). All other words, known or not, fall into BUCKETS
classes by their last two bytes, with P(word | bucket) = (count + 1) / (sum of counts + 1 over the
bucket's known words, + 1 for an unknown one). Output biases start at the unigram model.

Training uses every training document once. A text is encoded once, into a written table of units; in
each of ROUNDS rounds the documents of one slice, dealt by a hash of id and text to groups of about
GROUP tokens, train the current model by truncated backpropagation: windows of WINDOW tokens over many
lanes (Adam), the state carried from window to window through a whole document however long it is, and
cleared only where a document starts. The groups' weights are averaged by tokens, FAN of them at a
time. The groups follow from the table alone, so scores don't change with the cluster's layout (but
for the last digits of sums).

Scoring carries the state across windows from a document's first token to its end; many documents run
side by side in lanes. Columns pass through Arrow unchanged, so ids of any size stay exact beside nulls.

Defined cases: null and empty texts are the end token alone; repeated rows count and are scored each;
a null doc_id is read as empty text for the split; with no training rows every count is 0; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import table, written

FOLDS, HELD_FOLD = 7, 2
RANKED = 100_000
WORDS, CLASS, BUCKETS = 2048, 64, 64
STATE, EMBED = 32, 24
WINDOW, LANES, LEAST_STEPS = 32, 256, 80
#: Steps that scoring takes at a time: nothing is cut there, so it only says how often tables are read again.
SPAN = 128
ROUNDS = 2
RATE = 6e-3
#: Targets of a training step at least: where only the ends of long documents are left, their windows are joined to segments of so many.
SEGMENT = 512
#: Tokens of a training group, about.
GROUP = 2_000_000
FAN = 64
_CHUNK = 4_000_000
#: Rows of the output layer that are worked on at a time, so that they stay in the processor's cache.
_ROWS = 1024
#: Bytes of text that are cut into words at a time.
_BYTES = 1 << 22
_END = b""
_CLASSES = WORDS // CLASS + BUCKETS
_START = WORDS + BUCKETS


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _held(rows: DataFrame) -> DataFrame:
    return rows.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD)


def _cut(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in parts of about _BYTES bytes, a longer text alone."""
    ends = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    start = 0
    while start < len(texts):
        to = max(start + 1, int(np.searchsorted(ends, ends[start] + _BYTES, "right")) - 1)
        yield texts[start:to]
        start = to


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text has, and the tokens as bytes: its lower-cased words and the end (empty). Null is empty."""
    kept = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # a space after the last word makes an empty one, the end; an empty text is one by itself
    spaced = pc.if_else(pc.equal(kept, ""), kept, pc.binary_join_element_wise(kept, "", " "))
    split = pc.ascii_split_whitespace(spaced)
    return split.value_lengths().to_numpy().astype(np.int64), split.flatten().cast(pa.binary())


def counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end), n over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            seen = pc.value_counts(pa.chunked_array(held))
            return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["word", "n"])

        for batch in batches:
            for part in _cut(batch.column("text")):
                held.append(tokens_of(part)[1])
                size += len(held[-1])
                if size >= _CHUNK:
                    yield found()
                    held, size = [], 0
        if held:
            yield found()

    training = _held(docs.select("doc_id", "text")).where(~F.col("held_out")).select("text")
    return training.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ranks of the frequent words (the end is rank 0), their counts, and the buckets' sums."""

    def __init__(self, ranked: list[tuple[bytes, int]], total: int, distinct: int, sums: dict[int, int]):
        self.words = [_END, *[w for w, _ in ranked if w != _END]]
        found = dict(ranked)
        self.n = np.array([found.get(w, 0) for w in self.words], np.float64)
        self.total, self.distinct = total, distinct
        mass = np.ones(BUCKETS)
        for b, s in sums.items():
            mass[b] += s
        for w, n in zip(self.words[:WORDS], self.n[:WORDS], strict=True):
            if n:
                mass[bucket_of(w)] -= n + 1
        self.mass = np.maximum(mass, 1.0)

    def prepare(self):
        """In a task: the words as one array, log10(count + 1), units, and the bucket of the words that end in two bytes or are a single one. Later tasks of a process find it done."""
        if hasattr(self, "ranked"):
            return self
        self.bucket = np.array([bucket_of(i.to_bytes(2, "big")) for i in range(1 << 16)], np.int32)
        self.short = np.array([bucket_of(bytes([i])) for i in range(1 << 8)], np.int32)
        self.unit = np.array([i if i < WORDS else WORDS + bucket_of(w) for i, w in enumerate(self.words)], np.int32)
        self.log = np.log10(self.n + 1)
        self.ranked = pa.array(self.words, pa.binary())
        return self

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (-1: not ranked) and units of the network of the words (binary)."""
        ranks = pc.fill_null(pc.index_in(words, value_set=self.ranked), -1).to_numpy()
        units, far = self.unit[np.maximum(ranks, 0)], np.flatnonzero(ranks < 0)
        if len(far):
            ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :], np.frombuffer(words.buffers()[2], np.uint8)
            last = ends[far + 1] - 1
            before = data[np.maximum(last - 1, 0)].astype(np.int32)
            units[far] = WORDS + np.where(last > ends[far], self.bucket[before << 8 | data[last]], self.short[data[last]])
        return ranks, units

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ranks and units of each token with the end, and the words that aren't ranked."""
        words = tokens_of(pa.array([(text or "").encode("utf-8", "surrogatepass")]).view(pa.string()))[1]
        ranks, units = self.encode_words(words)
        return ranks, units, words.filter(pa.array(ranks < 0)).to_pylist()


class GatedLM:
    """Parameters and passes of the network; a unit is a word, a bucket or the start."""

    def __init__(self, vocabulary: Vocabulary | None = None, seed: int = 11):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.rooms: dict[str, np.ndarray] = {}
        self.p = {
            "embed": normal(_START + 1, EMBED, scale=0.3),
            "input": normal(EMBED, 3 * STATE, scale=EMBED**-0.5),
            "loop": normal(STATE, 3 * STATE, scale=STATE**-0.5),
            "gate": np.zeros(3 * STATE, np.float32),
            "class": normal(STATE, _CLASSES, scale=0.02),
            "class_base": np.zeros(_CLASSES, np.float32),
            "word": normal(WORDS, STATE, scale=0.02),
            "word_base": np.zeros(WORDS, np.float32),
        }
        if vocabulary is not None:
            n = np.full(WORDS, 0.5)
            n[: min(WORDS, len(vocabulary.n))] = vocabulary.n[:WORDS] + 0.5
            self.p["word_base"][:] = np.log(n)
            self.p["class_base"][:] = np.log(np.concatenate([n.reshape(-1, CLASS).sum(axis=1), vocabulary.mass]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> GatedLM:
        return self._view(flat.astype(np.float32))

    def _view(self, flat: np.ndarray) -> GatedLM:
        """From now on the parameters are parts of ``flat``."""
        self.p = self._parted(flat)
        return self

    def _parted(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of ``flat`` that stand where ``flat()`` puts each parameter."""
        ends = itertools.accumulate(self.p[k].size for k in sorted(self.p))
        return {k: flat[end - self.p[k].size : end].reshape(self.p[k].shape) for k, end in zip(sorted(self.p), ends, strict=True)}

    def _room(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        """An array of undefined content that the next call with this name takes back: fresh memory for every window costs more than the work on it."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size or self.rooms[name].dtype != kind:
            self.rooms[name] = np.empty(size, kind)
        return self.rooms[name][:size].reshape(shape)

    def _parts(self, name: str) -> list[np.ndarray]:
        """The columns of update gate, reset gate and candidate, each contiguous."""
        return [np.ascontiguousarray(self.p[name][:, i * STATE : (i + 1) * STATE]) for i in range(3)]

    def _inputs(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What each unit feeds to update gate, reset gate and candidate, and the recurrent weights of these; the gates' negated, as their sums are needed so."""
        p = self.p
        fed = p["embed"] @ p["input"] + p["gate"]
        fed, loops = [np.ascontiguousarray(fed[:, i * STATE : (i + 1) * STATE]) for i in range(3)], self._parts("loop")
        for a in (*fed[:2], *loops[:2]):
            a *= -1
        return fed, loops

    def tables(self):
        """What ``states``, ``log_probability`` and ``gradients`` derive from the parameters; good until these change."""
        return self._inputs(), self._weights()

    def states(self, x: np.ndarray, h: np.ndarray, keep_all: bool = False, passing: bool = False, tables=None):
        """The state after each of the inputs x (time, lane), from h; a start sets its lane to zero first.

        With ``keep_all`` also what the way back needs: states before each step, both gates, candidate, and its recurrent part.
        These, and with ``passing`` the states, last until the next call.
        """
        p, (steps, lanes) = self.p, x.shape
        kind = np.result_type(p["loop"].dtype, h.dtype)
        fed, loops = self._inputs() if tables is None else tables[0]
        every = self._room("every", (steps + 1, lanes, STATE), kind) if keep_all or passing else np.empty((steps + 1, lanes, STATE), kind)
        every[0] = h
        size = steps if keep_all else 1
        gates = self._room("gates", (size, 2, lanes, STATE), kind)
        candidates, mixed, row = (self._room(name, (*lead, lanes, STATE), kind) for name, lead in (("candidates", (size,)), ("mixed", (size,)), ("row", ())))
        reset = x == _START
        at_start = reset.any(axis=1).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                k = t if keep_all else 0
                g, n, u, before, new = gates[k], candidates[k], mixed[k], every[t], every[t + 1]
                if at_start[t]:
                    before = np.where(reset[t][:, None], kind.type(0), before)
                for i in (0, 1):
                    np.matmul(before, loops[i], out=g[i])
                    fed[i].take(x[t], axis=0, out=row, mode="clip")
                    g[i] += row
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                np.matmul(before, loops[2], out=u)
                fed[2].take(x[t], axis=0, out=row, mode="clip")
                np.multiply(g[1], u, out=n)
                n += row
                np.tanh(n, out=n)
                np.subtract(before, n, out=new)
                new *= g[0]
                new += n
        return every[1:], every[steps], (every, gates, candidates, mixed, reset)

    def _sorted(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Rows with a target in the order of its class, their classes, and where each class of words starts."""
        inner = WORDS // CLASS
        c = np.where(y < 0, _CLASSES, np.where(y < WORDS, y // CLASS, y - WORDS + inner)).astype(np.uint16)
        order = np.argsort(c, kind="stable")[: int((y >= 0).sum())]
        c = c[order]
        return order, c.astype(np.int64), np.searchsorted(c, np.arange(inner + 1)).tolist()

    def _weights(self):
        """The output layers' weights with bases lowered to at most 0, and what no sum of an output can exceed: a state is inside [-1, 1]."""
        p = self.p
        words = p["word_base"].reshape(-1, CLASS)
        most = max(np.abs(p["class"]).sum(axis=0).max(), np.abs(p["word"]).sum(axis=1).max())
        return p["class"], p["class_base"] - p["class_base"].max(), p["word"], (words - words.max(axis=1, keepdims=True)).reshape(-1), most

    @staticmethod
    def _exp(a: np.ndarray, bound: float) -> np.ndarray:
        """exp in place, each row up to a factor."""
        if bound > 60 and a.size and (most := float(a.max())) > 60:  # rows far apart can't lose all of their weight then
            a -= a.max(axis=1, keepdims=True) if most > 80 else a.dtype.type(most - 60)
        return np.exp(a, out=a)

    def log_probability(self, h: np.ndarray, y: np.ndarray, tables=None) -> np.ndarray:
        """Natural log of P(unit y) at each state; of a bucket as a whole."""
        outer, outer_base, inner, inner_base, bound = self._weights() if tables is None else tables[1]
        order, c, cuts = self._sorted(y)
        y, found = y[order], np.empty(len(order))
        h = h.take(order, axis=0, out=self._room("taken", (len(order), STATE), h.dtype), mode="clip")
        ones = np.ones(max(_CLASSES, CLASS), h.dtype)
        for at in range(0, len(order), _ROWS):
            a = h[at : at + _ROWS] @ outer
            a += outer_base
            found[at : at + _ROWS] = self._share(a, c[at : at + _ROWS], ones, bound)
        for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for at in range(start, end, _ROWS):
                to, of = min(end, at + _ROWS), slice(k * CLASS, (k + 1) * CLASS)
                a = h[at:to] @ inner[of].T
                a += inner_base[of]
                found[at:to] += self._share(a, y[at:to] - k * CLASS, ones, bound)
        out = np.empty(len(order))
        out[order] = found
        return out

    def _share(self, a: np.ndarray, target: np.ndarray, ones: np.ndarray, bound: float) -> np.ndarray:
        """Log of each row's share of exp(a) at its target."""
        picked = np.arange(len(a)) * a.shape[1] + target
        e = self._exp(a, bound)
        with np.errstate(divide="ignore"):
            return np.log(e.reshape(-1)[picked] / (e @ ones[: a.shape[1]]))

    def gradients(self, x: np.ndarray, y: np.ndarray, h0: np.ndarray, tables=None, into: dict[str, np.ndarray] | None = None):
        """Of the mean cross-entropy over targets y >= 0, back to the start of the window; and the last state. With ``into``, those of the sum are added to it."""
        p, (steps, lanes) = self.p, x.shape
        tables = self.tables() if tables is None else tables
        out, last, (every, gates, candidates, mixed, reset) = self.states(x, h0, keep_all=True, tables=tables)
        kind = every.dtype
        outer, outer_base, inner, inner_base, bound = tables[1]
        order, c, cuts = self._sorted(y.reshape(-1))
        target, h = y.reshape(-1)[order], self._room("states", (len(order), STATE), kind)
        out.reshape(-1, STATE).take(order, axis=0, out=h, mode="clip")
        scale, ones = kind.type(1 / max(1, len(order)) if into is None else 1), np.ones(max(_CLASSES, CLASS, _ROWS), kind)
        g = {k: np.zeros_like(a) for k, a in p.items()} if into is None else into
        back, turned = self._room("back", h.shape, kind), np.ascontiguousarray(outer.T)

        def layer(at: int, to: int, weights, base, aim, found, found_base) -> tuple[np.ndarray, np.ndarray]:
            """The outputs' gradients, and the factor that each row still lacks: it goes to the states, which are narrower."""
            a = h[at:to] @ weights
            a += base
            self._exp(a, bound)
            total = a @ ones[: a.shape[1]]
            a.reshape(-1)[np.arange(to - at) * a.shape[1] + aim] -= total
            share = scale / total
            found += (a.T @ (h[at:to] * share[:, None])).T
            found_base += share @ a
            return a, share[:, None]

        for at in range(0, len(order), _ROWS):
            to = min(len(order), at + _ROWS)
            a, share = layer(at, to, outer, outer_base, c[at:to], g["class"], g["class_base"])
            np.matmul(a, turned, out=back[at:to])
            back[at:to] *= share
        for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            of = slice(k * CLASS, (k + 1) * CLASS)
            for at in range(start, end, _ROWS):
                to = min(end, at + _ROWS)
                a, share = layer(at, to, inner[of].T, inner_base[of], target[at:to] - k * CLASS, g["word"][of].T, g["word_base"][of])
                a = a @ inner[of]
                a *= share
                back[at:to] += a
        wanted = self._room("wanted", (steps * lanes, STATE), kind)
        if len(order) < len(wanted):
            wanted[:] = 0
        wanted[order] = back
        wanted = wanted.reshape(steps, lanes, STATE)
        # side by side for each step and lane: candidate, update gate, reset gate, candidate's recurrent part
        d, carry = self._room("steps", (steps, lanes, 4 * STATE), kind), np.zeros((lanes, STATE), kind)
        back_loop = np.ascontiguousarray(p["loop"].T)
        dh, dz, dn, update, rest = (np.empty((lanes, STATE), kind) for _ in range(5))
        at_start = reset.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            before, (z, r), n, u = every[t], gates[t], candidates[t], mixed[t]
            if at_start[t]:
                before = np.where(reset[t][:, None], kind.type(0), before)
            to_candidate, to_update, to_reset, to_loop = (d[t, :, i * STATE : (i + 1) * STATE] for i in range(4))
            np.add(wanted[t], carry, out=dh)
            np.multiply(dh, z, out=dz)
            np.subtract(dh, dz, out=dn)
            np.subtract(before, n, out=update)
            update *= dn
            np.multiply(update, z, out=to_update)
            np.multiply(n, n, out=rest)
            np.subtract(1, rest, out=rest)
            dn *= rest
            to_candidate[:] = dn
            dn *= r
            to_loop[:] = dn
            dn *= u
            np.subtract(1, r, out=rest)
            np.multiply(dn, rest, out=to_reset)
            np.matmul(d[t, :, STATE:], back_loop, out=carry)
            carry += dz
            if at_start[t]:
                carry[reset[t]] = 0
        first, units = every[:-1].reshape(-1, STATE), x.reshape(-1)
        back, gone = d.reshape(-1, 4 * STATE), np.flatnonzero(reset)
        fed, looped = back[:, : 3 * STATE], back[:, STATE:]
        g["loop"] += first.T @ looped
        if len(gone):
            g["loop"] -= first[gone].T @ looped[gone]
        seen = self._room("seen", (len(units), EMBED), kind)
        p["embed"].take(units, axis=0, out=seen, mode="clip")
        turn = np.r_[STATE : 3 * STATE, :STATE]  # fed's columns in the order of the parameters
        g["gate"] += (np.ones(len(units), kind) @ fed)[turn]
        g["input"] += (seen.T @ fed)[:, turn]
        moved = np.matmul(fed, p["input"][:, np.r_[2 * STATE : 3 * STATE, : 2 * STATE]].T, out=self._room("moved", (len(units), EMBED), kind))
        order = np.argsort(units.astype(np.uint16), kind="stable")
        units = units[order]
        cuts = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
        g["embed"][units[cuts]] += np.add.reduceat(moved.take(order, axis=0, out=seen, mode="clip"), cuts, axis=0)
        return g, last

    def train(self, pieces: list[np.ndarray], rate: float) -> int:
        """One pass over the sequences of units; returns their tokens."""
        total = sum(map(len, pieces))
        lanes = int(min(LANES, max(8, total // (WINDOW * LEAST_STEPS))))
        w = self.flat()
        self._view(w)
        m, v, held, live, step, f = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0, 0, np.float32
        into, tables = self._parted(held), None
        least = min(SEGMENT, lanes * WINDOW // 2)

        def move() -> None:
            nonlocal live, step, tables
            tables = None
            a = held * f(1 / live)
            a *= f(min(1.0, 1.0 / (math.sqrt(float(a @ a)) + 1e-9)))
            held[:], live, step = 0, 0, step + 1
            np.multiply(m, f(0.9), out=m)
            np.multiply(v, f(0.99), out=v)
            v[:] += f(0.01) * (a * a)
            a *= f(0.1)
            m[:] += a
            np.multiply(v, f(1 / (1 - 0.99**step)), out=a)
            np.sqrt(a, out=a)
            a += f(1e-6)
            np.divide(m, a, out=a)
            a *= f(rate / (1 - 0.9**step))
            w[:] -= a

        for x, y, _, h in _windows(pieces, lanes, WINDOW):
            tables = tables or self.tables()
            h[: x.shape[1]] = self.gradients(x, y, h[: x.shape[1]], tables, into)[1]
            live += int((y >= 0).sum())
            if live >= least:
                move()
        if live:
            move()
        return total

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Sum of natural log P(unit) of each whole sequence."""
        out, tables = np.zeros(len(sequences)), self.tables()
        for x, y, of, h in _windows(sequences, LANES, SPAN):
            states, last, _ = self.states(x, h[: x.shape[1]], passing=True, tables=tables)
            h[: x.shape[1]] = last
            states, y, of = states.reshape(-1, STATE), y.reshape(-1), of.reshape(-1)
            if not (live := y >= 0).all():
                states, y, of = states[live], y[live], of[live]
            out += np.bincount(of, self.log_probability(states, y, tables), len(sequences))
        return out


def _windows(sequences: list[np.ndarray], lanes: int, steps: int):
    """Inputs, targets (-1: none), sequence numbers and lane states, window by window. Sequences stand one after the other in lanes of even length; the longest lanes come first, and lanes that have ended leave."""
    if not sequences:
        return
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    heap = [(0, k, []) for k in range(min(lanes, len(sequences)))]
    for i in order:
        size, k, members = heap[0]
        members.append(i)
        heapq.heapreplace(heap, (size + len(sequences[i]), k, members))
    heap.sort(key=lambda x: -x[0])
    flat = [i for _, _, members in heap for i in members]
    y = np.concatenate([sequences[i] for i in flat])
    sizes = np.array([len(sequences[i]) for i in flat])
    of, starts = np.repeat(np.array(flat), sizes), np.cumsum(np.append(0, sizes))[:-1]
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[starts] = _START
    length = np.array([s for s, _, _ in heap])
    offset = np.cumsum(np.append(0, length))[:-1]
    h = np.zeros((len(length), STATE), np.float32)
    for t in range(0, int(length[0]), steps):
        active = int(np.searchsorted(-length, -t, "left"))
        time = t + np.arange(min(steps, int(length[0]) - t))[:, None]
        valid = time < length[:active]
        at = np.minimum(offset[:active] + time, len(y) - 1)
        yield np.where(valid, x[at], _START), np.where(valid, y[at], -1), of[at], h


def _averaged(updates: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' weights (columns task, tokens, weights), FAN tasks at a time."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = rows["tokens"].to_numpy(np.float64)
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for w, n in zip(rows["weights"], tokens, strict=True))
        return pd.DataFrame({"task": [int(rows["task"].min()) // FAN], "tokens": [tokens.sum()], "weights": [(total / tokens.sum()).astype(np.float32).tobytes()]})

    left = updates.agg(F.max("task")).first()[0]
    while left is not None:
        updates = written(updates.groupBy(F.floor(F.col("task") / FAN).alias("_group")).applyInPandas(mean, "task long, tokens double, weights binary"), "lm-mean")
        if left < FAN:
            return np.frombuffer(updates.first().weights, np.float32)
        left //= FAN
    return None


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every document once, written: doc_id, held_out, slot (a hash of id and text), its units (16 bits each), and the sums that need no network."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    sums = ("n", "known", "logs", "local")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.prepare()
        mass = np.log10(words.mass)
        for batch in batches:
            start = 0
            for texts in _cut(batch.column("text")):
                size, tokens = tokens_of(texts)
                ranks, units = words.encode_words(tokens)
                ends = np.cumsum(np.append(0, size))
                at, seen = ends[:-1], ranks >= 0
                log = words.log[ranks] * seen
                wide = units >= WORDS
                local = np.where(wide, log - mass[np.where(wide, units - WORDS, 0)], 0.0)
                known = seen & (words.n[ranks] > 0)
                flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(2 * ends), pa.py_buffer(units.astype("<u2"))])
                far = np.cumsum(np.append(0, ~seen))[ends].astype(np.int32)
                columns = {
                    **{c: batch.column(c).slice(start, len(size)) for c in ("doc_id", "held_out", "slot")},
                    **dict(zip(sums, (pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.add.reduceat(log, at)), pa.array(np.add.reduceat(local, at))), strict=True)),
                    "units": flat.cast(pa.binary()),
                    "rare": pa.ListArray.from_arrays(pa.array(far), tokens.filter(pa.array(~seen))),
                }
                start += len(size)
                yield pa.RecordBatch.from_pydict(columns)

    part = _held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("slot", F.xxhash64("doc_id", "text"))
    return written(part.mapInArrow(run, "doc_id long, held_out boolean, slot long, n long, known long, logs double, local double, units binary, rare array<binary>").withColumn("row", F.monotonically_increasing_id()), "lm-encoded")


def _units(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(u, "<u2").astype(np.int32) for u in batch.column("units").to_pylist()]


def learn(docs: DataFrame, group: int | None = None) -> tuple[Vocabulary, GatedLM, DataFrame, DataFrame]:
    """The vocabulary, the trained network, and the written tables of all counts and of the encoded documents."""
    spark = docs.sparkSession
    counted = written(counts(docs), "lm-counts")
    bucket = F.crc32(F.substring("word", -2, 2)) % BUCKETS
    sums = counted.groupBy(bucket.alias("b")).agg(F.sum(F.col("n") + 1).alias("s"), F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")  # at most 64 * 16 steps of the counts
    least, among = 0, 0
    for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("v")).orderBy(F.desc("size")).collect():
        if among + r.v > RANKED:
            least = r.size + 1
            break
        among += r.v
    ranked = sorted(((bytes(r.word), r.n) for r in counted.where(size >= least).collect()), key=lambda r: (-r[1], r[0]))
    vocabulary = Vocabulary(ranked, sum(r.n for r in sums), sum(r.v for r in sums), {r.b: r.s for r in sums})
    net, rows = GatedLM(vocabulary), encoded(docs, vocabulary)
    groups = max(1, math.ceil(vocabulary.total / ROUNDS / (group or GROUP)))
    for number in range(ROUNDS):
        weights = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], weights=weights, rate=RATE / (1 + number)) -> Iterator[pa.RecordBatch]:
            net, held, size, tokens, task = GatedLM().load(weights.value), [], 0, 0, None
            for batch in batches:
                task = batch.column("part")[0].as_py() if batch.num_rows else task
                for units in _units(batch):
                    held.append(units)
                    size += len(units)
                    if size >= _CHUNK:
                        tokens, held, size = tokens + net.train(held, rate), [], 0
            if held:
                tokens += net.train(held, rate)
            if tokens:
                yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "tokens": [float(tokens)], "weights": [net.flat().tobytes()]})

        chosen = rows.where(~F.col("held_out") & (F.pmod("slot", F.lit(ROUNDS)) == number)).select("slot", "units")
        dealt = chosen.repartition(groups, "slot").sortWithinPartitions("slot").select("units", F.spark_partition_id().alias("part"))
        mean = _averaged(written(dealt.mapInArrow(run, "task long, tokens double, weights binary"), "lm-round"))
        if mean is not None:
            net.load(mean)
    return vocabulary, net, counted, rows


def scores(docs: DataFrame, vocabulary: Vocabulary, net: GatedLM, counted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, from its whole text; ``rows``: the documents encoded before."""
    spark = docs.sparkSession
    rows = encoded(docs, vocabulary) if rows is None else rows
    weights = spark.sparkContext.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, units, size = GatedLM().load(weights.value), [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            found, at = net.score(units) / math.log(10), 0
            for batch in held:
                columns = {c: batch.column(c) for c in ("doc_id", "held_out", "n", "known", "logs", "row")}
                yield pa.RecordBatch.from_pydict(columns | {"model": pa.array(batch.column("local").to_numpy() + found[at : at + batch.num_rows])})
                at += batch.num_rows
            held.clear()
            units.clear()

        for batch in batches:
            held.append(batch.drop_columns(["units"]))
            units += (new := _units(batch))
            size += sum(map(len, new))
            if size >= _CHUNK:
                yield from scored()
                size = 0
        if held:
            yield from scored()

    part = rows.select("doc_id", "held_out", "n", "known", "logs", "local", "units", "row")
    scored = part.mapInArrow(run, "doc_id long, held_out boolean, n long, known long, logs double, row long, model double")
    rare = rows.select("row", F.explode("rare").alias("word"))
    found = rare.join(counted, "word").groupBy("row").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    zero = F.lit(0.0)
    found = scored.join(found, "row", "left")
    return found.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", zero) - F.col("n") * F.lit(math.log10(vocabulary.total + vocabulary.distinct + 1))).alias("base_score"),
        (F.col("model") + F.coalesce("more", zero)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, *learn(docs))
