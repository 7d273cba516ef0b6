import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kithgraph.llm import sstable, token_ids


@pytest.fixture(scope="module")
def library():
    whole = Tokenizer.from_file(token_ids.vocabulary())
    whole.encode_special_tokens = True
    return whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aé日 \n\t\r'st.,9½ |<>"), max_size=40))
def test_ids_are_the_library_s(library, text):
    assert token_ids.encoder(token_ids.vocabulary())(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_table_round_trip(spark, library, tmp_path):
    rows = [(5, "abc def"), (5, "abc"), (None, "x y"), (-7, None), (9, ""), (2**40, "zzz " * 50_000), *[(i, f"doc {i}") for i in range(100, 400)]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    manifest = sstable.write(docs, f"file://{tmp_path}/t")
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in sstable.read(manifest).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, ids))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    readers = [sstable.Reader(r.path) for r in manifest.collect()]
    found = {k: sum(len(r.get(k)) for r in readers) for k in (5, None, -7, 9, 2**40, 250, 99, 10**9)}
    assert found == {5: 2, None: 1, -7: 1, 9: 1, 2**40: 1, 250: 1, 99: 0, 10**9: 0}
    assert sstable.read(sstable.write(docs.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_files_end_at_a_size(spark, tmp_path):
    """One hot doc_id over several files, and the order across them."""
    docs = spark.createDataFrame([(7 if i % 2 else i, f"text {i:05d} " * 400) for i in range(300)], "doc_id long, text string")
    manifest = sstable.write(docs, f"file://{tmp_path}/t", shard=64 << 10)
    parts = manifest.collect()
    assert len(parts) >= 8 and max(r.ids for r in parts) < 100_000
    got = sorted(((r.start, r.doc_id, len(r.ids) // 4) for r in sstable.read(manifest).collect()))
    assert [i for _, i, _ in got] == sorted(i for _, i, _ in got) and len(got) == 300
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_look_up_across_files(spark, tmp_path):
    """Ids in one file, in several and in none, null ids, and ids that doubles can't tell apart; the same rows as a scan."""
    big = 2**53
    ids = [*[7 if i % 3 == 0 else i for i in range(240)], *[None] * 40, -5, big, big + 1, big + 1, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(k, f"text {n:05d} " * 400 if n % 50 else None) for n, k in enumerate(ids)], "doc_id long, text string")
    manifest = sstable.write(docs, f"file://{tmp_path}/t", shard=64 << 10)
    assert manifest.count() >= 8
    everything = sstable.read(manifest).collect()
    for wanted in ([7], [None], [8, 7, 7, None, 10**9, -6, -5, big + 1, big + 2, 2**63 - 1, -(2**63)], [10**12], [], sorted({k for k in ids if k is not None})):
        asked = spark.createDataFrame([(w, "x") for w in wanted], "id long, ids string")
        got = sstable.look_up(manifest, asked, "id").collect()
        assert sorted(got, key=lambda r: r.start) == sorted((r for r in everything if r.doc_id in wanted), key=lambda r: r.start)
    nothing = sstable.write(docs.limit(0), f"file://{tmp_path}/e")
    assert sstable.look_up(nothing, docs).count() == 0


def test_paths_without_scheme_are_those_of_spark(spark, tmp_path):
    from kithgraph.storage import qualified

    assert qualified(spark, "/shared/t") == "file:/shared/t"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://head:8020")
    try:
        assert qualified(spark, "/shared/t") == "hdfs://head:8020/shared/t" and qualified(spark, "s3a://b/t") == "s3a://b/t" and qualified(spark, "file:///x") == "file:///x"
    finally:
        conf.set("fs.defaultFS", before)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert sstable.read(sstable.write(docs, f"{tmp_path}/plain")).count() == 1


def test_damage_is_seen(tmp_path):
    path = f"{tmp_path}/a.sst"
    out = sstable.Writer(f"file://{path}", 2)
    for i in range(20_000):
        out.add(sstable.key_of(i), np.arange(i % 7, dtype="<u2"))
    out.close()
    reader = sstable.Reader(f"file://{path}")
    assert len(reader.blocks) > 3 and reader.get(12_345)[0].tolist() == list(range(12_345 % 7)) and not reader.get(20_001)
    raw = bytearray(open(path, "rb").read())
    raw[100] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(f"file://{path}").scan())
    open(path, "wb").write(raw[:-9])
    with pytest.raises(ValueError):
        sstable.Reader(f"file://{path}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "a", "é", "\n", "word"]), max_size=12).map("".join))
def test_special_tokens_are_read_as_the_library_reads_them(text):
    library = Tokenizer.from_file(token_ids.vocabulary())
    assert token_ids.encoder(token_ids.vocabulary())(text).tolist() == library.encode(text, add_special_tokens=False).ids
