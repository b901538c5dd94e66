import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parlance.operators.parse import parse_transcripts
from parlance.streaming import jobs


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_segments_arrive_once(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    chunks = [{"recording_id": 1, "chunk": k, "text": f"[00:01] 【A】 text {k}\n[00:20] 【B】 more", "length": 60.0, "offset": 60.0 * k} for k in range(3)]

    def put(name, rows):
        (src / name).write_text("\n".join(map(json.dumps, rows)))
        jobs.stream_segments(spark, str(src), sink, str(tmp_path / "cp")).awaitTermination()

    put("a.json", chunks[:2])
    put("b.json", [chunks[1], chunks[2]])  # one chunk comes again
    want = parse_transcripts(spark.createDataFrame(chunks, jobs.CHUNK))
    assert rows_of(spark.read.parquet(f"{sink}/segments").drop("batch").select(want.columns)) == rows_of(want)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_progress_and_activity_end_like_the_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    shape = lambda df: df.select(F.col("user_id").alias("recording_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("speaker_id"), (F.col("event_id") % 2 == 0).alias("reviewed"), F.col("ts").cast("timestamp").alias("at"))
    run(jobs.stream_progress(shape(stream)), "progress", "complete")
    assert rows_of(spark.table("progress")) == rows_of(jobs.stream_progress(shape(events)))
    run(jobs.stream_activity(shape(stream), "1 hour", "0 seconds"), "activity", "complete")
    assert rows_of(spark.table("activity")) == rows_of(shape(events).groupBy("recording_id", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("recording_id", "w.start", "w.end", "n").toDF("recording_id", "from", "to", "n"))


def test_last_write_wins(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, 5, t + timedelta(minutes=m), b, "speaker", a) for m, b, a in [(1, 1, "x"), (3, 3, "z"), (2, 2, "y"), (3, 3, "z")]] + [(2, 5, t, 9, "text", "q")]
    layout = "recording_id long, target long, at timestamp, batch_id long, kind string, after string"
    for k in range(2):
        spark.createDataFrame(rows[k::2], layout).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    run(jobs.stream_edits(stream), "edits", "update")
    last = {}
    for r in spark.table("edits").collect():
        if (r.recording_id, r.target) not in last or last[r.recording_id, r.target].at <= r.at:
            last[r.recording_id, r.target] = r
    assert {k: v.after for k, v in last.items()} == {(1, 5): "z", (2, 5): "q"}


def test_late_edits_go_aside(spark, tmp_path):
    """Against plain Python, batch by batch; a batch that is run again changes nothing."""
    t = datetime(2024, 1, 1)
    layout = "recording_id long, target long, at timestamp, batch_id long, kind string, after string"
    make = lambda r, target, minute, b: (r, target, t + timedelta(minutes=minute), b, "speaker", f"v{b}")
    batches = [
        [make(1, 5, 10, 1), make(1, 5, 12, 2), make(1, 5, 12, 3), make(2, 7, 0, 4), make(1, 5, 10, 1)],
        [make(1, 5, 11, 5), make(1, 5, 12, 3), make(1, 5, 12, 9), make(2, 7, 1, 6), make(3, 1, 2, 7), make(2, 8, 30, 8)],
        [make(9, 9, 19, 10), make(2, 8, 25, 11), make(2, 8, 31, 12), make(2, 7, 31, 13)],
    ]
    (tmp_path / "e").mkdir()
    latest, late, top = {}, [], None
    sink, state = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in batches:
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        jobs.apply_edits(spark.readStream.schema(layout).parquet(str(tmp_path / "e")), sink, state, "10 minutes").awaitTermination()
        before = dict(latest)
        for row in sorted(set(rows), key=lambda x: (x[2], x[3]), reverse=True):
            key = row[:2]
            if row[:4] == before.get(key, ())[:4]:  # sent again
                continue
            if top and row[2] < top - timedelta(minutes=10):
                late.append((row[3], "behind"))
            elif key in latest and (row[2], row[3]) < (latest[key][2], latest[key][3]):
                late.append((row[3], "older"))
            else:
                latest[key] = row
        top = max([*(x[2] for x in rows), *([top] if top else [])])
    read = lambda: (sorted(tuple(r) for r in jobs.read_latest(spark, sink).select("recording_id", "target", "at", "batch_id", "kind", "after").collect()), sorted((r.batch_id, r.reason) for r in spark.read.parquet(f"{sink}/late").collect()))
    assert read() == (sorted(latest.values()), sorted(late)) and {x for _, x in late} == {"behind", "older"}
    commits = tmp_path / "cp" / "commits"
    for f in commits.iterdir():
        if f.name.lstrip(".").startswith("2"):
            f.unlink()  # as if the driver had died before the last batch was committed
    jobs.apply_edits(spark.readStream.schema(layout).parquet(str(tmp_path / "e")), sink, state, "10 minutes").awaitTermination()
    assert read() == (sorted(latest.values()), sorted(late))


def test_a_failed_chunk_is_taken_when_it_comes_again(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    chunk = lambda k, text, **more: {"recording_id": 1, "chunk": k, "text": text, "length": 60.0, "offset": 60.0 * k, "key": "m"} | more
    said = lambda k: f"[00:01] 【A】 text {k}\n[00:20] 【B】 more"
    files = [[chunk(0, said(0)), chunk(1, None), chunk(2, "429", failed=True)], [chunk(1, said(1)), chunk(2, " "), chunk(0, said(0))], [chunk(2, said(2)), chunk(1, said(1)), chunk(2, said(2)), chunk(0, said(7), key="n")], [chunk(2, None)]]
    for k, rows in enumerate(files):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        jobs.stream_segments(spark, str(src), sink, str(tmp_path / "cp")).awaitTermination()
    want = parse_transcripts(spark.createDataFrame([tuple(chunk(k, said(k)).values())[:5] for k in range(3)], jobs.CHUNK))
    again = parse_transcripts(spark.createDataFrame([tuple(chunk(0, said(7)).values())[:5]], jobs.CHUNK))  # made with another key
    got = spark.read.parquet(f"{sink}/segments").drop("batch").select(want.columns)
    assert sorted((r.chunk, r.seg_start, r.text) for r in got.collect()) == sorted((r.chunk, r.seg_start, r.text) for r in want.unionByName(again).collect())
    from parlance.sources import store

    assert {(r.chunk, r.key): r.failed for r in store.read(spark, f"{sink}/done").collect()} == {(0, "m"): False, (1, "m"): False, (2, "m"): False, (0, "n"): False}
