import random

import numpy as np

from kithgraph.llm import simhash


def brute(points, radius=3):
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(points))]


def planted(n=400, seed=3):
    r = random.Random(seed)
    points = []
    for _ in range(n):
        p = r.getrandbits(64)
        points.append(p)
        for _ in range(r.choice((0, 0, 1, 6))):
            p ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 3, 4))))
            points.append(p)
    return list(dict.fromkeys(points))


def test_local_links_match_all_pairs():
    points = planted()
    a, b = simhash.local_links(np.array(points, np.uint64), np.empty(0, np.uint64), leaf=8)
    label = list(range(len(points)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[x] = y
    want = brute(points)
    assert len({(x, y) for x, y in zip(label, want, strict=True)}) == len(set(want)) == len(set(label))


def test_groups_over_many_shards(spark):
    points = planted(300, 5)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), shard_rows=32)).collect()
    root = {r.node: r.root for r in found}
    got = [root.get(p, p) for p in signed]
    want = brute(points)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(500))
    rows = [(3, text, 1), (1, text.upper(), 1), (1, text.upper(), 1), (5, None, 1), (4, "", 1), (6, " \t", 1), (7, "a b", None), (None, text, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = {(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()}
    assert found == {(3, 1), (1, 1), (None, 1), (5, 4), (4, 4), (6, 4), (7, 7)}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 4, 7]
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("x" * 100_000) != 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(300)) for c in "ABCDEF"}
    rows = [(2, "A"), (5, "A"), (5, "B"), (None, "C"), (None, "D"), (None, "D"), (None, "E"), (None, "A"), (7, "F"), (7, "F"), (None, "F")]
    docs = spark.createDataFrame([(i, text[c], c) for i, c in rows], "doc_id long, text string, _number string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r[2], r.doc_id) for r in got.collect()), key=str) == [("A", 2), ("B", 5), ("C", None), ("D", None), ("E", None), ("F", 7)]


def plain_simhash(text):
    """Bit by bit, with an XXH64 of its own over whole shingles."""
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = int.from_bytes(xxhash.xxh64(s.encode(), seed=42).digest(), "big")
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def test_fingerprints_are_simhashes(spark):
    texts = ["one two three four", "One\tTWO\nthree", "a", "a b", "ÄÖ Äö   x", "repeat repeat repeat repeat", " \r\n", None, "x " * 3000, "tie a", "straße STRASSE   wide"]
    assert [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts] == [plain_simhash(t) for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_wide_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "a b c d"), (None, "other words here now"), (2**53 + 1, "third text of all"), (-(2**63) + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in simhash.groups(docs).collect()), key=str) == sorted((i for i, _ in rows), key=str)
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == set(rows)
