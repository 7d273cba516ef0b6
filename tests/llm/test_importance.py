import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kithgraph.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def counted(text, buckets, longest=1):
    return Counter(zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1])


def brute(docs, target, percent, least, buckets, longest):
    """Dictionaries and loops; repeated rows stand in a list."""
    here, there = Counter(), Counter()
    for _, text in docs:
        here.update(counted(text, buckets, longest))
    for text in target:
        there.update(counted(text, buckets, longest))
    s, t = sum(here.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1) * (s + buckets) / ((here[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        c = counted(text, buckets, longest)
        weight, score = sum(n * gain[b] for b, n in c.items()), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, sum(c.values()), weight, score, None, len(features(text)[0])])
    pool = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def got(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBzZ09 \n\t\x00.,_-éßΑ漢  😀`{@", max_size=60), st.integers(1, 3))
def test_counts_of_any_text(text, longest):
    words, where, many = importance.counts(text.encode(), importance._Buckets(97), longest)
    assert words == len(features(text)[0])
    assert dict(zip(where.tolist(), many.tolist(), strict=True)) == counted(text, 97, longest)


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 50)
    r = random.Random(2)
    for text in (" ".join(r.choice(("alpha", "B", "gamma-delta", "é")) for _ in range(900)), "x" * 500, "a " + "x" * 500 + " b c", " " * 400):
        for longest in (1, 3):
            words, where, many = importance.counts(text.encode(), importance._Buckets(97), longest)
            assert words == len(features(text)[0]) and dict(zip(where.tolist(), many.tolist(), strict=True)) == counted(text, 97, longest)


def test_against_plain_loops(spark):
    r = random.Random(1)
    words = [*"abcdefghij", "É", "x9", "漢字"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(300)]
    hot = " ".join(words * 3)
    docs += [(1000 + i, hot) for i in range(200)] + [(7, hot), (7, hot), (7, "a b c"), (None, hot), (None, None), (900, None), (901, ""), (902, " .. "), (903, "word " * 40_000), (2**53 + 1, hot)]
    target = ["a b a b", "x9 É", None, "", hot]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, words int, rank int").repartition(6)
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    assert got(importance.resampled(df, aim)) == brute(docs, target, 10, 20, 10_000, 1)
    assert got(importance.resampled(df, aim, percent=55, least_words=3, buckets=50, longest=3)) == brute(docs, target, 55, 3, 50, 3)
    assert importance.resampled(df.limit(0), aim).count() == 0
    assert got(importance.resampled(df, aim.limit(0))) == brute(docs, [], 10, 20, 10_000, 1)


def test_blocks_hold_every_row_and_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    blocks = importance.csr_blocks(docs, 100).collect()
    assert sorted(i for b in blocks for i in b.doc_id) == list(range(3000))
    assert max(len(b.doc_id) for b in blocks) <= importance.BLOCK_ROWS
    for b in blocks:
        assert len(b.starts) == len(b.doc_id) + 1 and b.starts[0] == 0 and b.starts[-1] == len(b.buckets) == len(b.counts)
    sums = importance.column_sums(importance.csr_blocks(docs, 100), 100)
    assert sums.sum() == 9000 and (sums == np.bincount([k for i in range(3000) for k in counted(f"a b {i}", 100).elements()], minlength=100)).all()


def test_blocks_stay_small_where_documents_are_long(spark):
    """Spark's reader unpacks 4,096 blocks of a file at once, whatever they hold."""
    r = random.Random(5)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(60)]
    docs += [(i, " ".join(f"w{7 * k % 7919}" for k in range(n))) for i, n in ((500, 511), (501, 512), (502, 513), (503, 4000), (503, 4000), (None, 4000), (504, 30_000), (505, 0))]
    docs += [(1000 + i, "a b") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = importance.csr_blocks(df).collect()
    assert max(len(b.buckets) for b in blocks) * 4096 * 28 < 64 << 20 and max(len(b.doc_id) for b in blocks) * 4096 * 44 < 64 << 20  # bytes with Parquet's levels
    seen = {}
    for b in blocks:
        assert len(b.starts) == len(b.doc_id) + 1 == len(b.words) + 1 and b.starts[0] == 0 and b.starts[-1] == len(b.buckets) == len(b.counts)
        assert not b.part or len(b.doc_id) == 1
        for k, (i, words) in enumerate(zip(b.doc_id, b.words, strict=True)):
            of, at = seen.setdefault(b.first + k, [i, 0, Counter()]), slice(b.starts[k], b.starts[k + 1])
            assert of[0] == i
            of[1] += words
            of[2].update(dict(zip(b.buckets[at], b.counts[at], strict=True)))
    assert [seen[k] for k in sorted(seen)] == [[i, len(t.split()), counted(t, 10_000)] for i, t in docs]
    target = ["w1 w2 a", docs[0][1]]
    assert got(importance.resampled(df.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))) == brute(docs, target, 10, 20, 10_000, 1)


def test_the_draw_leans_to_the_target(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcde" if i % 4 else "vwxyz") for _ in range(25))) for i in range(400)]
    rows = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("v w x y z " * 30,)], "text string")).where("rank is not null").collect()
    assert len(rows) == 40 and all(x.doc_id % 4 == 0 for x in rows)
