import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kithgraph.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def level(sizes):
    """target of each source, by filling sources up one after the other."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, rest = {}, dict(weight), 1.5 * sum(sizes.values())
    while free:
        full = [s for s in free if rest / sum(free.values()) * free[s] >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
            del free[s]
    return target | {s: rest / sum(free.values()) * w for s, w in free.items()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"word{i} " * (i % 17), f"s{i % 3}", i) for i in range(120)]
    rows += [(7, "same text here", "s0", 1), (7, "same text here", "s0", 1), (7, "same text here", "s1", 1), (7, "other text", "s0", 1)]
    rows += [(None, f"nobody {i % 3}", None, 0) for i in range(9)] + [(None, None, None, 0), (500, "", "s1", 0), (501, " \n", "s1", 0), (502, "long " * 30_000, "s2", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, _turn int")


def test_each_row_is_dealt(odd):
    rows, docs = odd
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += size(text)
    target, taken = level(sizes), defaultdict(int)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1.001 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in found)


def test_the_mix_holds_what_was_dealt(odd):
    rows, docs = odd
    want = Counter()
    for r in mixing.mix(docs).collect():
        want.update((r.source, p) for p in (r.taken_1, r.taken_2) if p)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = mixed.collect()
    assert Counter((r.source, size(r.text)) for r in found) == want
    whole = {(i, s, t) for i, t, s, _ in rows}
    assert sum((r.doc_id, r.source, r.text) not in whole for r in found) <= 2 * 4  # cut at a source's end
    copies = Counter((r.doc_id, r.source, r.text) for r in found)
    assert all(n <= 2 * sum((i, s, t) == k for i, t, s, _ in rows) or k not in whole for k, n in copies.items())


def test_empty_table(spark, odd):
    none = odd[1].limit(0)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_positions_invert_the_schedules(spark):
    for knots in mixing.SCHEDULES:
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        at = [r.t for r in spark.range(11).select(mixing.position(F.col("id").cast("double"), F.lit(10.0), knots).alias("t")).collect()]
        assert at == sorted(at) and at[0] == 0 and abs(at[-1] - 1) < 1e-9
        (t0, m0), (t1, m1) = knots
        for k, t in enumerate(at):
            assert abs((m0 * t + (m1 - m0) * t * t / 2) / whole - k / 10) < 1e-9


def test_ids_that_many_rows_lack_or_share_are_split(spark, monkeypatch):
    """Half of the rows without id, a third of one id, all of two sizes: no range holds much more than its share, and the words before each row follow the order."""
    rows = [(None if i % 2 else 7 if i % 3 else i, "one two" if i % 5 else "three", "s0") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    seen, real = [], mixing.ranged
    monkeypatch.setattr(mixing, "ranged", lambda *a: seen.append(real(*a)) or seen[-1])
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = mixing.mix(docs).collect()
        groups = [r["count"] for r in seen[0].groupBy("source", "_b").count().collect()]
    finally:
        spark.conf.set(name, before)
    assert len(groups) == 4 and max(groups) < 2 * 8000 / 4
    left, want = 1.5 * sum(size(t) for _, t, _ in rows), Counter()
    dealt = sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), size(t), i) for i, t, _ in rows), key=lambda r: r[:2])
    whole = sum(n for _, n, _ in dealt)
    at = 0
    for _, n, i in dealt:
        parts = [max(0, min(n, int(left) - at - k * whole)) for k in (0, 1)]
        want[(i, n, sum(parts))] += 1
        at += n
    assert Counter((r.doc_id, r.size, r.taken) for r in found) == want
