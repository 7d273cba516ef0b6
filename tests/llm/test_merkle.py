import hashlib
import re

from pyspark.sql import functions as F

from kithgraph.llm import merkle


def brute(rows):
    """Contract columns and likenesses from sorted rows, by plain Python."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    leaf = lambda t: [hashlib.md5(p.encode()).hexdigest()[:8] for p in re.findall(merkle.paragraph_pattern(), t)]
    near = lambda a, b: 1.0 if a == b else 2 * len({*a} & {*b}) / (len({*a}) + len({*b}))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), near(leaf(t), leaf(e)), near(leaf(t), leaf(n))))
    return sorted(out)


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(merkle, "WINDOW_ROWS", 2)
    rows = [(i * i - 700, f"line {i}\nmore words é日 {i % 7} " * (i % 13)) for i in range(150)]
    rows += [(5, "dup"), (5, "dup"), (5, "dup two"), (None, "no id"), (None, "another"), (10**12, None), (10**12 + 1, ""), (77, "x" * 200_000), (78, " \n\n \t\n")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bucket string")
    got = merkle.compare_with_edits(docs)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got.collect()) == brute(rows)
    for few in ([(1, "alone")], [(None, "a"), (None, None)]):
        small = merkle.compare_with_edits(spark.createDataFrame(few, "doc_id long, text string"))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in small.collect()) == brute(few)
    assert merkle.compare_with_edits(docs.limit(0)).count() == 0


def test_roots_and_edits(spark):
    words = [f"w{i}" for i in range(1000)]
    changed = [*words]
    changed[333] = "edit"
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(changed))]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", merkle.leaves(F.col("text")).alias("l"))
    a, b, c = [r.f for r in df.select("doc_id", merkle.fingerprint(F.col("l"), merkle.sections(F.col("l"))).alias("f")).orderBy("doc_id").collect()]
    assert a == b != c
    pair = spark.createDataFrame([(a, b), (a, c)], "x string, y string")
    assert [r[0] for r in pair.select(merkle.locate_edits(F.col("x"), F.col("y"))).collect()] == [[], [333 // merkle.WORDS]]


def test_texts_whose_short_digests_meet_have_roots_of_their_own(spark):
    seen, i = {}, 0
    while (short := hashlib.md5(f"w{i}".encode()).hexdigest()[:8]) not in seen:
        seen[short] = i
        i += 1
    df = spark.createDataFrame([(1, f"w{seen[short]}"), (2, f"w{i}")], "doc_id long, text string").select("doc_id", merkle.leaves(F.col("text")).alias("l"))
    a, b = [r.f for r in df.select("doc_id", merkle.fingerprint(F.col("l"), merkle.sections(F.col("l"))).alias("f")).orderBy("doc_id").collect()]
    assert a.split(":")[0] != b.split(":")[0]
    assert spark.createDataFrame([(a, b)], "x string, y string").select(merkle.locate_edits(F.col("x"), F.col("y"))).first()[0] == [0]


def brute_trees(rows):
    """Contract columns, tree likeness and edits from sorted rows, by plain Python."""
    from collections import Counter

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)

    def tree(text):
        leaf = [md5(p) for p in re.findall(merkle.paragraph_pattern(), text)]
        section = [md5("".join(leaf[i : i + merkle.SECTION])) for i in range(0, len(leaf), merkle.SECTION)]
        return md5("".join(section)), section, leaf

    def near(a, b):
        a, b = (Counter([*t[1], *t[2], "root" + t[0]]) for t in (a, b))
        return 2 * (a & b).total() / (a.total() + b.total())

    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = tree(t), tree(e), tree(n)
        edits = [j for j, x in enumerate(b[2]) if j >= len(a[2]) or a[2][j] != x]
        out.append((str(i), hashlib.sha256(e.encode()).hexdigest(), *[":".join([x[0], "".join(x[1]), "".join(x[2])]) for x in (a, b)], near(a, b), near(a, c), ",".join(map(str, edits))))
    return sorted(out)


def test_trees_against_plain_python(spark):
    rows = [(i * i - 700, f"line {i}\nmore words é日 {i % 7} " * (i % 13)) for i in range(120)]
    rows += [(5, "dup"), (5, "dup"), (5, "dup two"), (None, "no id"), (None, "another"), (10**12, None), (10**12 + 1, ""), (77, "x" * 200_000), (78, " \n\n \t\n"), (79, "same\n" * 3000), (80, "same\n" * 2000 + "b\na\n"), (2**53 + 1, "alpha\nbeta\nalpha\n"), (2**53 + 2, "beta\nalpha\n")]
    got = merkle.compare_trees(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, a string"))
    found = sorted((str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.edits) for r in got.collect())
    assert found == brute_trees(rows)
    assert merkle.compare_trees(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_roots_mean_equal_texts_in_the_query(spark):
    """Two texts whose digests share 32 bits, and two that have the same set of leaves."""
    rows = [(1, "doc 103869"), (2, "doc 144755"), (3, "alpha\nbeta\nalpha\n"), (4, "beta\nalpha\n"), (5, "a\nb\n"), (6, "b\na\n")]
    got = {r.doc_id: r for r in merkle.compare_trees(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({r.fingerprint.split(":")[0] for r in got.values()}) == 6
    assert all(r.near_next < 1 for r in got.values())
