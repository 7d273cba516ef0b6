import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kithgraph.llm import lm


def brute(rows):
    """Contract columns but the score, by plain Python."""
    counts = Counter()
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    for ts, h in zip(tokens, held, strict=True):
        if not h:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    return [(str(i), h, len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for (i, _), ts, h in zip(rows, tokens, held, strict=True)]


@pytest.fixture()
def small(monkeypatch):
    for name, value in {"RANKED": 40, "WORDS": 16, "CLASS": 4, "BUCKETS": 8, "_CLASSES": 12, "_START": 24, "SEGMENT": 32, "LEAST_STEPS": 10}.items():
        monkeypatch.setattr(lm, name, value)


def test_gradients_match_differences(small):
    net = lm.GatedLM(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 25, (5, 3)), r.integers(-1, 24, (5, 3))
    h = r.standard_normal((3, lm.STATE)) * 0.1

    def loss():
        out = net.states(x, h)[0].astype(np.float64).reshape(-1, lm.STATE)
        live = y.reshape(-1) >= 0
        return -net.log_probability(out[live], y.reshape(-1)[live]).mean()

    g = net.gradients(x, y, h)[0]
    for name, at in (("embed", (int(x[2, 1]), 4)), ("input", (3, 55)), ("loop", (5, 8)), ("loop", (5, 60)), ("gate", (30,)), ("class", (2, 3)), ("class_base", (9,)), ("word", (int(y[y >= 0].min()), 7)), ("word_base", (3,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-4, name


def test_lanes_carry_whole_documents(small):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 24, n).astype(np.int32) for n in (1, 70, 3, 200, 33, 32, 31, 1)]
    net = lm.GatedLM(seed=5)
    together = net.score(docs)
    for d, s in zip(docs, together, strict=True):
        x = np.array([lm._START, *d[:-1]])[:, None]
        out = net.states(x, np.zeros((1, lm.STATE), np.float32))[0]
        assert abs(net.log_probability(out[:, 0], d).sum() - s) < 1e-2
    units = np.arange(lm._START)
    total = np.exp(net.log_probability(np.repeat(out[-1], lm._START, axis=0), units)).sum()
    assert abs(total - 1) < 1e-4


def test_two_thousand_words_have_probabilities_of_their_own():
    words = [(f"w{i}".encode(), 5000 - i) for i in range(3000)]
    vocabulary = lm.Vocabulary(words, sum(n for _, n in words), len(words), {}).prepare()
    units = vocabulary.encode(" ".join(f"w{i}" for i in (0, 1500, 2000, 2500)))[1]
    assert units[:3].tolist() == [1, 1501, 2001] and units[3] >= lm.WORDS == 2048
    p = lm.GatedLM(vocabulary).p
    assert lm.BUCKETS == 64 and p["loop"].shape == (32, 96) and p["embed"].shape == (2048 + 64 + 1, 24)


def test_counts_and_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANKED", 40)  # the other words' counts come through the join
    texts = ["the cat sat on the mat", "The dog é sat", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, None, "", " \n", "rare%d unique", "word " * 3000]
    rows = [(i, (texts[i % len(texts)] or None) and texts[i % len(texts)].replace("%d", str(i))) for i in range(90)] + [(7, "dup dup"), (7, "dup dup"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = lm.scores(docs, *lm.learn(docs)).collect()
    key = lambda r: (r[0], r[2], r[3])
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want]) and all(g[6] < 0 for g in got)
    none = docs.limit(0)
    assert lm.scores(none, *lm.learn(none)).count() == 0
    held = docs.where("doc_id = 2").withColumn("doc_id", docs.doc_id * 0 + next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2))
    only = lm.scores(held, *lm.learn(held)).collect()
    assert only[0].train_tokens == only[0].n_known == 0 and only[0].base_score == 0


def test_the_model_beats_the_base_on_held_out_documents(spark):
    got = lm.query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got["score"].sum() > 0.95 * got["base_score"].sum() and len(got) > 100


def test_scores_follow_from_the_table_alone(spark):
    """Ids beyond 2^53 beside nulls, one id with several texts, and a document longer than many windows; the layout doesn't matter."""
    rows = [(2**53 + 1, "a b c"), (None, "d e"), (2**53 + 1, "other words"), (3, "word and word " * 2000), *[(i, f"w{i % 7} and w{i % 3} or so") for i in range(10, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for layout in (docs.coalesce(1), docs.repartition(5)):
        vocabulary, net, counted, encoded = lm.learn(layout, group=2000)
        got = lm.scores(layout, vocabulary, net, counted, encoded).collect()
        found.append(sorted(((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got)))
        assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert found[0] == found[1]
    again = lm.scores(docs, vocabulary, net, counted).collect()
    assert sorted(((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 3)) for r in again)) == found[0]


def test_state_is_carried_in_training_and_only_starts_clear_it(small):
    r = np.random.default_rng(2)
    long = r.integers(0, 24, 300).astype(np.int32)
    windows = list(lm._windows([long], 8, lm.WINDOW))
    assert sum((x == lm._START).sum() - (y < 0).sum() for x, y, _, _ in windows) == 1
    net = lm.GatedLM(seed=8)
    assert net.train([long, long[:50]], 1e-3) == 350


def test_gradients_of_single_precision_follow_double_where_outputs_are_large(small):
    """Shares are scaled on the states, not on the wider outputs: sums of exp far from 1 must not cost digits."""
    r = np.random.default_rng(4)
    net, exact = lm.GatedLM(seed=6), lm.GatedLM(seed=6)
    for name in ("class", "word"):
        net.p[name] *= 400
    exact.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(0, 25, (6, 4)), r.integers(-1, 24, (6, 4))
    h = r.uniform(-1, 1, (4, lm.STATE))
    assert net.tables()[1][-1] > 60
    found, want = net.gradients(x, y, h.astype(np.float32))[0], exact.gradients(x, y, h)[0]
    for name, g in want.items():
        assert np.isfinite(found[name]).all() and np.abs(found[name] - g).max() < 1e-3 * max(1e-3, np.abs(g).max()), name


def test_words_and_units_are_those_of_plain_python(monkeypatch):
    """Odd spaces, control characters, bytes that aren't ASCII, nulls; texts larger than a part stand alone in one."""
    monkeypatch.setattr(lm, "_BYTES", 200)
    r = random.Random(5)
    letters = [" ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "A", "b", "Z", "é", "İ", "\x00", "日", "word"]
    texts = [None, "", " ", "q", "x" * 500, *["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(3000)]]
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    counts = Counter(w for ws in want for w in ws)
    vocabulary = lm.Vocabulary(counts.most_common(30), 1, 1, {}).prepare()
    rank = {w: i for i, w in enumerate(vocabulary.words)}
    at = 0
    for part in lm._cut(pa.array(["before", *texts], pa.string())[1:]):
        sizes, tokens = lm.tokens_of(part)
        ranks, units = vocabulary.encode_words(tokens)
        words = [w for ws in want[at : at + len(part)] for w in ws]
        assert sizes.tolist() == [len(ws) for ws in want[at : at + len(part)]] and tokens.to_pylist() == words
        assert ranks.tolist() == [rank.get(w, -1) for w in words]
        assert units.tolist() == [rank.get(w, lm.WORDS + lm.bucket_of(w)) for w in words]
        assert len(part) == 1 or sum(len((t or "").encode()) for t in texts[at : at + len(part)]) <= 200
        at += len(part)
    assert at == len(texts)
    assert vocabulary.encode("A \ud800b q")[2] == [w for w in (b"a", b"\xed\xa0\x80b", b"q") if w not in rank]


def test_encoding_takes_less_than_a_look_up_of_each_word():
    """Words are cut and ranked by the column, so that they never become Python objects."""
    r = random.Random(6)
    words = [f"word{i}" for i in range(20_000)]
    text = " ".join(r.choices([*words, *(f"other{i}" for i in range(2000))], k=400_000))
    vocabulary = lm.Vocabulary([(w.encode(), 5) for w in words], 1, 1, {}).prepare()
    rank = {w: i for i, w in enumerate(vocabulary.words)}

    def best(work):
        took = []
        for _ in range(5):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    plain = best(lambda: np.fromiter(map(rank.get, [*text.encode().lower().split(), b""], [-1] * 400_001), np.int32))
    assert best(lambda: vocabulary.encode(text)) < 0.75 * plain
