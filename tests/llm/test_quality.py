import zlib

import numpy as np
import pandas as pd

from kithgraph.llm import quality


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
        rows = quality.chunks(data)
        back = {}
        starts = [0] if n <= quality.CHUNK else [*range(0, n - quality.CHUNK, quality.STEP), n - quality.CHUNK]
        for s, row in zip(starts, rows, strict=True):
            back |= {s + i: b for i, b in enumerate(row.tolist()) if b < 256}
        assert bytes(back[i] for i in range(n)) == data


def test_gradients_match_differences():
    net = quality.ByteConv(0.5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] += 0.05  # away from the corner of the rectifier
    rows = [quality.chunks(bytes(range(40, 120)) * 9), quality.chunks(b"hello there"), quality.chunks(b"")]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        p = net._head(np.maximum(net._pooled(np.concatenate(rows))[0], 0), starts)[2]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net._gradients(rows, y)
    for name, at in (("filter", (5, 3)), ("embed", (104, 2)), ("bias", (7,)), ("hidden", (40, 1)), ("out", (2,)), ("base", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = quality.query(spark, path).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{path}/labels.parquet").set_index("doc_id")["quality"]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all() and len(got) == 1000
    test = got[got["held_out"]].join(labels, how="inner")
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.85
    assert (test[test["quality"] == 1]["predicted"] == 1).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 5), (3, "", 5), (None, "x " * 100_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    got = quality.scores(docs, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs.drop("score"), labels).count() == 5
    assert quality.scores(docs.limit(0), net).count() == 0


def naive_score(net, text):
    """The network position by position, in plain loops."""
    p, size = net.p, quality.CHUNK
    data = list(text) if len(text) > size else [*text, *[256] * (size - len(text))]
    starts = [0] if len(data) == size else [*range(0, len(data) - size, quality.STEP), len(data) - size]
    answers = []
    for s in starts:
        e = [p["embed"][b] for b in data[s : s + size]]
        row = []
        for f in range(quality.FILTERS):
            best = max(sum(float(e[i + w] @ p["filter"][w * quality.EMBED : (w + 1) * quality.EMBED, f]) for w in range(quality.WIDTH)) for i in range(0, size - quality.WIDTH + 1, quality.STRIDE))
            row.append(max(0.0, best + float(p["bias"][f])))
        answers.append(row)
    columns = list(zip(*answers, strict=True))
    d = [*[sum(c) / len(c) for c in columns], *map(max, columns), *map(min, columns)]
    z = [np.tanh(sum(x * float(p["hidden"][i, k]) for i, x in enumerate(d)) + float(p["shift"][k])) for k in range(quality.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(x * float(p["out"][k]) for k, x in enumerate(z)) + float(p["base"][0]))))


def test_scores_match_plain_loops():
    r = np.random.default_rng(4)
    net = quality.ByteConv(0.3, seed=9)
    net.p["bias"] += 0.1
    texts = [b"", b"short text", bytes(r.integers(0, 256, 256, np.uint8)), bytes(r.integers(0, 256, 700, np.uint8))]
    assert np.allclose(net.score(texts), [naive_score(net, t) for t in texts], atol=1e-5)


def test_wide_ids_and_long_texts_teach(spark):
    rows = [(2**53 + 1, "good " * 9000), (2**53 + 1, "good words"), (None, "x"), (2**53 + 3, "bad words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, 0)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    again = quality.train(docs.repartition(3), labels)
    assert all((net.p[k] == again.p[k]).all() for k in net.p)
    assert sorted((r.doc_id for r in quality.scores(docs, net).collect()), key=str) == sorted((i for i, _ in rows), key=str)
    wide = spark.createDataFrame([(1, "a", 2**53 + 1), (2, "b", None)], "doc_id long, text string, n_chars long").coalesce(1)
    assert {r.n_chars for r in quality.scores(wide, net, ("doc_id", "n_chars")).collect()} == {2**53 + 1, None}
