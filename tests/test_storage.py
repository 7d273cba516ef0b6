from pathlib import Path

from kithgraph import storage


def test_written_tables_go_when_discarded_and_no_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    (tmp_path / "other").mkdir()
    assert storage.written(spark.range(5), "numbers").count() == 5
    folder = Path(storage._folder(spark).removeprefix("file://"))
    assert folder.parent == tmp_path and len(list(folder.glob("numbers-*"))) == 1
    assert storage.discard(spark) and not folder.exists() and (tmp_path / "other").exists()
    assert not storage.discard(spark)
    assert storage.written(spark.range(3), "numbers").count() == 3
