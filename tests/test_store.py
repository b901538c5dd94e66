import pytest
from pyspark.sql import functions as F

from parlance.sources import caches, store

LAYOUT = "fingerprint string, id long, p_start double, status string"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def stored(spark, path):
    return rows_of(caches.read_proposals(spark, path), "fingerprint", "id", "status")


def test_decisions_stay(spark, tmp_path):
    path, make = str(tmp_path / "p"), lambda rows: spark.createDataFrame(rows, LAYOUT)
    caches.write_proposals(make([("a", 1, 0.0, "rejected"), ("a", 2, 0.0, "pending"), ("a", 3, 0.0, "accepted"), ("", 9, 0.0, "pending")]), path)
    caches.write_proposals(make([("b", 1, 0.0, "pending")]), path)  # another recording
    assert stored(spark, path) == [("a", 1, "rejected"), ("a", 2, "pending"), ("a", 3, "accepted"), ("b", 1, "pending")]
    caches.write_proposals(make([("a", 4, 0.0, "pending"), ("a", 3, 1.0, "rejected")]), path)  # pending 2 goes, 1 stays, 3 is decided anew
    assert stored(spark, path) == [("a", 1, "rejected"), ("a", 3, "rejected"), ("a", 4, "pending"), ("b", 1, "pending")]
    # read from and written to the same place
    both = caches.read_proposals(spark, path).withColumn("status", F.when(F.col("id") == 4, "accepted").otherwise(F.col("status")))
    caches.write_proposals(both, path)
    assert stored(spark, path) == [("a", 1, "rejected"), ("a", 3, "rejected"), ("a", 4, "accepted"), ("b", 1, "pending")]
    assert rows_of(caches.read_proposals(spark, path, "b"), "id") == [(1,)] and caches.read_proposals(spark, path, "none").count() == 0
    store.vacuum(spark, path, 1)
    assert len(stored(spark, path)) == 4 and len(list((tmp_path / "p" / "manifest").glob("*.json"))) == 1


def test_words_of_versions_and_recordings(spark, tmp_path):
    path, make = str(tmp_path / "w"), lambda *rows: spark.createDataFrame(rows, "recording_id long, text string, start double, end double")
    caches.write_words(make((1, "x", 0.0, 1.0), (2, "y", 0.0, 1.0), (None, "n", 0.0, 1.0)), path)
    caches.write_words(make((1, "z", 0.0, 1.0)), path, align_ver=7)
    caches.write_words(make((2, "yy", 0.0, 1.0), (None, "nn", 0.0, 1.0)), path, model="m")
    read = lambda **k: sorted((r.recording_id or 0, r.text, r.model) for r in caches.read_words(spark, path, **k).collect())
    assert read() == [(0, "nn", "m"), (1, "x", ""), (2, "yy", "m")] and read(align_ver=7) == [(1, "z", "")] and read(recording_id=2) == [(2, "yy", "m")]
    caches.write_words(make(), path)
    assert len(read()) == 3
    assert caches.read_words(spark, path, recording_id=2).inputFiles() and len(caches.read_words(spark, path, recording_id=2).inputFiles()) < len(caches.read_words(spark, path).inputFiles())


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second of two that finish at once begins again and loses nothing of the first."""
    path = str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(rows, "k long, v string, more int" if len(rows[0]) > 2 else "k long, v string")
    store.upsert(make((1, "a"), (2, "b")), path, ["k"], buckets=1)
    commit, calls = store._commit, []

    def late(spark, path, state):
        if not calls:
            calls.append(1)
            store.upsert(make((3, "c")), path, ["k"])
        return commit(spark, path, state)

    monkeypatch.setattr(store, "_commit", late)
    store.upsert(make((2, "bb", 5)), path, ["k"])
    assert {tuple(r) for r in store.read(spark, path).select("k", "v", "more").collect()} == {(1, "a", None), (2, "bb", 5), (3, "c", None)}
    (tmp_path / "t" / "manifest" / "000000000099.json").write_text('{"number": 9')  # half written
    assert store.latest(spark, path)["number"] == 3
    store.upsert(make((4, "d")), path, ["k"])
    assert store.latest(spark, path)["number"] == 100 and store.read(spark, path).count() == 4


def test_absent_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))
    empty = spark.createDataFrame([], "k long, v string")
    store.upsert(empty, str(tmp_path / "e"), ["k"])
    assert store.read(spark, str(tmp_path / "e")).collect() == [] and store.exists(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        store.upsert(empty, str(tmp_path / "e"), ["v"])
