import random

from pyspark.sql import functions as F

from kithgraph.llm import revisits


def test_canonical(spark):
    same = ["http://www.A.com:80/x/?q=1#f", "https://a.com/x/?q=1", "a.com:443/x/?q=1"]
    found = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(revisits.canonical(F.col("u"))).collect()}
    assert found == {"a.com/x/?q=1"}


def test_different_pages_keep_their_keys(spark):
    keys = {
        "http://a.com/x?u=b/": "a.com/x?u=b/", "http://a.com/x?u=b": "a.com/x?u=b", "http://a.com/x/": "a.com/x", "http://a.com/x//": "a.com/x/", "a.com/": "a.com", "a.com?": "a.com?",
        "https://a.com:80/": "a.com:80", "http://a.com:443/y": "a.com:443/y", "https://a.com:443": "a.com", "HTTP://a.com:80": "a.com", "ftp://a.com:80/": "a.com:80", "a.com:8080/": "a.com:8080", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in keys], "u string")
    assert {r.u: r.k for r in rows.select("u", revisits.canonical(F.col("u")).alias("k")).collect()} == keys


SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, length long, key string"


def test_against_a_scan_in_time(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        url = r.choice(["http://hot.com/a"] * 5 + ["http://b.com/%d" % r.randrange(9), None])
        ts = r.choice([r.randrange(60), r.randrange(60), None])
        kind, status = r.choice([("response", 200), ("response", 500), ("revisit", 304), ("revisit", 304), (None, None)])
        headers = r.choice([None, {"etag": r.choice(['"a"', 'W/"a"', '"b"']), "date": str(i), "content-type": f"t{i}"}, {"last-modified": r.choice("xy"), "via": "p"}, {}])
        rows.append((i, url, ts, kind, status, headers, r.choice([None, "d1", "d2"]), i, "clash"))
    rows.append(rows[7])
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA), buckets=6).collect()
    full = [x for x in rows if x[3] == "response" and x[4] == 200 and x[1] is not None and x[2] is not None]
    weak = lambda t: t and t.removeprefix("W/")
    want = {}
    for x in rows:
        h = x[5] or {}
        if x[3] != "revisit":
            want[x[0]] = ("full", None, h, x[6], x[7])
            continue
        earlier = [f for f in full if x[1] is not None and x[2] is not None and f[1] == x[1] and (f[2], f[0]) < (x[2], x[0])]
        if not earlier:
            want[x[0]] = ("missing", None, h, x[6], x[7])
            continue
        f = max(earlier, key=lambda y: (y[2], y[0]))
        o = f[5] or {}
        ok = weak(h["etag"]) == weak(o.get("etag")) if "etag" in h else h["last-modified"] == o.get("last-modified") if "last-modified" in h else x[6] == f[6] if x[6] else None
        if ok is False:
            want[x[0]] = ("mismatch", f[0], h, x[6], x[7])
        else:
            merged = {**o, **{k: v for k, v in h.items() if k not in revisits.KEPT_HEADERS}}
            want[x[0]] = ("resolved" if ok else "unchecked", f[0], merged, f[6], f[7])
    assert len(got) == len(rows)
    for g in got:
        assert (g.state, g.refers_to, g.headers, g.digest, g.length) == want[g.record_id], g
    assert {w[0] for w in want.values()} == {"full", "missing", "mismatch", "resolved", "unchecked"}
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
