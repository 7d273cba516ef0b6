"""Each stage against brute force on the smallest tables, with the stage before it as input."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from test_packing import check
from test_secret_scan import contract
from test_simhash import brute

from kithgraph.llm import mixing, secret_scan, simhash
from kithgraph.llm.common import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, DIR), "test-pipeline")
        found.append(docs.collect())
    return found


def test_columns_and_names(spark, stages):
    for rows in stages[:-1]:
        assert rows[0].__fields__ == stages[0][0].__fields__
    assert len(cp.STAGES) == 5


def test_classifier_only_removes(spark, stages):
    before, after = Counter(map(tuple, stages[0])), Counter(map(tuple, stages[1]))
    assert not after - before and len(stages[1]) > 0.7 * len(stages[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    points = [simhash.fingerprint(r.text) & (1 << 64) - 1 for r in rows]
    groups = defaultdict(list)
    for r, g in zip(rows, brute(points), strict=True):
        groups[g].append(r)
    assert sorted(map(tuple, stages[2])) == sorted(tuple(min(g, key=lambda r: r.doc_id)) for g in groups.values())


def test_secrets_are_redacted(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        old = before[r.doc_id].text or ""
        assert not contract(r.text or "") and r.n_chars == len(r.text or "")
        if not contract(old) and not secret_scan.candidates(old, []):
            assert r.text == old


def test_mix_takes_what_the_targets_say(spark, stages):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sources = defaultdict(int)
    for r in stages[3]:
        sources[r.source] += size(r)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s)))}
    target, free, rest = {}, dict(weight), 1.5 * sum(sources.values())
    while True:
        level = rest / sum(free.values())
        full = [s for s in free if level * free[s] >= 2 * sources[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sources[s]
            rest -= target[s]
            del free[s]
    target |= {s: level * w for s, w in free.items()}
    taken = defaultdict(int)
    for r in stages[4]:
        taken[r.source] += size(r)
    assert all(abs(taken[s] - target[s]) < 1.001 for s in sources)
    order, want = defaultdict(int), Counter()
    for r in sorted(stages[3], key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
        for k in range(2):
            part = max(0, min(size(r), int(target[r.source]) - order[r.source] - k * sources[r.source]))
            if part:
                want[r.doc_id, part] += 1
        order[r.source] += size(r)
    assert Counter((r.doc_id, size(r)) for r in stages[4]) == want
    times = {x.doc_id: (x.position_1, x.position_2) for x in mixing.mix(spark.createDataFrame(stages[3])).collect()}
    assert all(0 <= t <= 1 for pair in times.values() for t in pair if t is not None)


def test_packing(stages):
    used, least = check(stages[5], [(r.doc_id, r.text) for r in stages[4]], 1024)
    assert used <= least * 1.02 + 1


def test_clashing_columns(spark):
    names = ["base", "candidates", "spans", "score", "c0", "hit", "_turn", "_quality"]
    docs = spark.createDataFrame([(i, f"some plain words {i} " * 5, "en", "a", 99, *[f"{n}{i}" for n in names]) for i in range(12)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    want = {r.doc_id: r for r in docs.collect()}
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), "test-clash")
        assert docs.columns[5:] == names
        assert all(tuple(r)[5:] == tuple(want[r.doc_id])[5:] for r in docs.collect())


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words here", None, "a", 15), (2, "some words here", None, "a", 15), (3, "x" * 30_000, "en", None, 30_000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES:
            docs = written(stage(spark, docs, DIR), "test-odd")
            docs.collect()


def test_ids_and_texts_stay_exact_in_every_stage(spark):
    """Ids beyond 2^53 beside nulls and one id with two texts, in one batch."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda c: " ".join(f"{c}{i} word" for i in range(60))
    rows = [(2**53 + 1, words("a"), "en", "s", 2**53 + 3), (None, words("b"), "en", "s", None), (2**53 + 1, words("c"), "en", "s", 7), (None, words("d"), None, "s", 8)]
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(tuple, cp.quality.keep_good(docs, none).collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, cp.simhash.keep_one(docs).collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, cp.secret_scan.redacted(docs).collect()), key=str) == sorted(rows, key=str)
    mixed = cp.mixing.mixed_documents(docs)
    assert {(r.doc_id, r.text[:2]) for r in mixed.collect()} == {(r[0], r[1][:2]) for r in rows}
    assert {r.doc_id for r in cp.packing.packed_documents(mixed).collect()} == {2**53 + 1, None}


def test_what_each_stage_returns_for_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words here", None, "a", 15), (2, "some words here", None, "a", 15), (3, "x" * 30_000, "en", None, 30_000)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    found = {name: [tuple(r) for r in stage(spark, docs, DIR).collect()] for name, stage in cp.STAGES[:-1]}
    kept = found["quality classifier"]
    assert set(kept) <= set(rows) and kept.count(rows[2]) in (0, 2) and all(kept.count(r) <= rows.count(r) for r in kept)
    single = found["SimHash near-dedup"]  # null and empty texts have the fingerprint zero
    assert len(single) == 3 and set(single) <= set(rows) and {2, 3} < {r[0] for r in single}
    redacted = found["secret scans"]
    assert sorted(((r[0], r[1] or "") for r in redacted), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    mixed = sorted((r[0], len(r[1].split()), r[3]) for r in found["mixing sources to target weights"])
    assert mixed == [(2, 2, "a"), (2, 3, "a"), (2, 3, "a"), (3, 1, None), (3, 1, None)]  # the null source stops at twice its word, source a gets 8.5 of its 6
    pieces = cp.pack_sequences(spark, docs, DIR).collect()
    assert sum(r.doc_id is None for r in pieces) == 1 and sorted(r.length for r in pieces if r.doc_id in (None, 1)) == [1, 1]
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3} and all(r.length <= 1024 for r in pieces)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, none, DIR)
        assert empty.columns == docs.columns and empty.count() == 0
    assert cp.pack_sequences(spark, none, DIR).count() == 0
