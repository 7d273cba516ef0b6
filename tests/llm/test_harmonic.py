import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kithgraph.llm import harmonic, token_ids


def padding(total, capacity):
    return 0 if not total & (total - 1) else capacity - total


def test_classes_and_cuts():
    lengths, cuts = harmonic.class_lengths(2048, 2), harmonic.fewest_pieces(2048, 2)
    assert lengths[0] == 2048 and {1 << j for j in range(12)} <= set(lengths)
    assert all(2048 - 2048 // n * n <= 2 for n in lengths)
    assert all(sum(cut) == total and set(cut) <= set(lengths) for total, cut in enumerate(cuts))
    assert harmonic.fewest_pieces(64, 0)[45] == (32, 8, 4, 1)
    assert sum(map(len, cuts)) < 0.65 * sum(bin(n).count("1") for n in range(2048))
    with pytest.raises(ValueError):
        harmonic.class_lengths(1000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40), st.integers(0, 3))
def test_one_worker_fills_bins_of_a_fixed_count(sizes, slack):
    cuts, lengths = harmonic.fewest_pieces(64, slack), harmonic.class_lengths(64, slack)
    filler = harmonic.Filler(3, 64, cuts, lengths)
    for i, n in enumerate(sizes):
        filler.add(i, np.arange(n, dtype="<u4"))
    filler.end()
    rows = filler.batch().to_pylist()
    bins, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append((r["start"], r["length"]))
        if r["sequence_id"] is not None:
            bins[r["sequence_id"]].append(r)
        else:
            assert not r["length"] & (r["length"] - 1)
    for b in bins.values():
        assert len({r["length"] for r in b}) == 1 and len(b) == 64 // b[0]["length"]
        assert 64 - len(b) * b[0]["length"] <= slack
    for i, n in enumerate(sizes):
        assert sorted(a for start, length in whole[i] for a in range(start, start + length)) == list(range(n))


def check(rows, docs, capacity, slack):
    library = Tokenizer.from_file(token_ids.vocabulary())
    want = defaultdict(int)
    for doc_id, text in docs:
        want[str(doc_id), np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    ids = {k[0]: k[1] for k in want}
    bins, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        covered[str(r.doc_id), r.doc_tokens].append((r.start, r.length))
        assert any(zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for (i, data) in want if i == str(r.doc_id) and len(data) == 4 * r.doc_tokens)
    assert set(covered) == {(i, len(data) // 4) for i, data in want}
    for (i, total), found in covered.items():
        copies = sum(n for (j, data), n in want.items() if j == i and len(data) == 4 * total)
        assert sorted(a for start, length in found for a in range(start, start + length)) == sorted(list(range(total)) * copies)
    padded = 0
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity and padding(at, capacity) <= slack
        padded += padding(at, capacity)
    assert len(ids) == len({str(i) for i, _ in docs})
    return padded


def test_against_the_library(spark):
    docs = [(i, "word " * (i * 7 % 90)) for i in range(150)]
    docs += [(7, "same"), (7, "same"), (None, "x"), (None, "x"), (900, None), (901, ""), (902, "long " * 3000), (2**53 + 1, "x<|endoftext|>y")]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, length int, worker string").repartition(5)
    for slack in (0, 2):
        padded = check(harmonic.packed_documents(df, capacity=64, slack=slack).collect(), docs, 64, slack)
        assert padded == 0 or slack
    check(harmonic.packed_documents(df).collect(), docs, 2048, 2)
    assert harmonic.packed_documents(df.limit(0)).count() == 0


def test_copies_of_one_document_and_workers_with_little(spark):
    """Half of the rows are one document; every worker has only loose pieces."""
    docs = [(5, "a b c d e f g h i")] * 200 + [(i, "word " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    rows = harmonic.packed_documents(df).collect()
    check(rows, docs, 2048, 2)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= total // 2048 + 40
