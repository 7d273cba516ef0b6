"""What becomes of responses that are missing, failed, malformed or empty."""

from kithgraph.sources import envelopes, schemas

CASES = [
    ("good", 200, '{"values":[{"authorProfileId":1,"subjectProfileId":2,"balance":"5"}],"total":1}', "ok"),
    ("created", 201, '{"values":[{"authorProfileId":1}]}', "ok"),
    ("none", 200, '{"values":[],"total":0}', "empty"),
    ("null", 200, '{"values":null}', "empty"),
    ("no key", 200, '{"total":3}', "empty"),
    ("cut", 200, '{"values":[{"authorProfileId":1', "malformed"),
    ("page", 200, "<html>busy</html>", "malformed"),
    ("blank", 200, "  ", "malformed"),
    ("nothing", 200, None, "malformed"),
    ("other kind", 200, '{"values":"soon"}', "malformed"),
    ("gone", 404, '{"values":[{"authorProfileId":1}]}', "not found"),
    ("down", 503, None, "failed"),
    ("down too", 500, '{"values":[{"authorProfileId":9}]}', "failed"),
    ("missing", None, None, "not found"),
    ("no code", None, '{"values":[{"authorProfileId":4}]}', "ok"),
]


def test_each_case_has_its_status(spark):
    rows = spark.createDataFrame([c[:3] for c in CASES], "name string, code int, payload string")
    found = envelopes.classified(rows, schemas.VOUCHES, code="code")
    got = {r.name: r for r in envelopes.messages(found, "vouches").collect()}
    assert {n: r.status for n, r in got.items()} == {c[0]: c[3] for c in CASES}
    assert all((r.envelope is None) == (r.status not in ("ok", "empty")) for r in got.values())
    assert got["gone"].message == "Vouches not found" and got["down"].message == got["cut"].message == "Failed to fetch vouches" and got["none"].message is None
    kept = {r.name: r.payload for r in envelopes.quarantine(found).collect()}
    assert kept == {c[0]: c[2] for c in CASES if c[3] in ("failed", "malformed")}
    assert sorted(r.author for r in envelopes.vouches(envelopes.fanned_out(found)).collect()) == [1, 1, 4]
    assert envelopes.classified(rows.limit(0), schemas.VOUCHES).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"values":[\n{"authorProfileId":1}]}')
    (tmp_path / "b.json").write_text('{"values":[')
    found = envelopes.classified(envelopes.responses(spark, str(tmp_path)), schemas.VOUCHES)
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in found.collect()) == [("a.json", "ok"), ("b.json", "malformed")]
