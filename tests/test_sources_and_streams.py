"""Files, snapshots, indexes and streams over small folders."""

import json

from pyspark.sql import functions as F

from ferrule.operators import lexical, spaces
from ferrule.sources import files, scratch
from ferrule.streaming import changes


def test_scan_with_rules(spark, tmp_path):
    for name in ("a.py", "b.txt", "sub/c.py", "skip/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.scan(spark, str(tmp_path), ["*.py"], ["skip"], "own")
    assert sorted((r.rel_path, r.size, r.space) for r in got.collect()) == [("a.py", 4, "own"), ("sub/c.py", 8, "own")]
    both = files.union_spaces(got, files.scan(spark, str(tmp_path), ["a.*"], space="other"))
    assert {r.rel_path: r.spaces for r in both.collect()} == {"a.py": ["other", "own"], "sub/c.py": ["own"]}
    assert {r.rel_path: r.text for r in files.contents(spark, str(tmp_path), ["*.txt"]).collect()} == {"b.txt": "b.txt"}


def test_written_tables_and_their_release(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", [])
    kept = scratch.written(spark.range(5), "t")
    assert kept.count() == 5 and scratch.spread(spark.range(8, numPartitions=1)).count() == 8
    path = scratch._made[0]
    scratch.release(spark)
    assert scratch._made == [] and scratch.pointer(spark, path) == {"version": 0, "mark": None}


def test_walk_leaves_folders_out(spark, tmp_path):
    for name in ("a.py", "sub/c.py", "skip/d.py", "sub/skip/deep/e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "z.py").symlink_to(tmp_path / "a.py")
    (tmp_path / "skip").chmod(0o000)
    try:
        got = files.walk(spark, str(tmp_path), ["*.py"], ["skip"], "own").collect()
    finally:
        (tmp_path / "skip").chmod(0o755)
    assert sorted(r.rel_path for r in got) == ["a.py", "sub/c.py"]
    files.write_text(spark, str(tmp_path / "x.json"), {"a": "é"})
    files.write_text(spark, str(tmp_path / "x.json"), {"a": [1]})
    assert (tmp_path / "x.json").read_text() == '{"a": [1]}' and len(list(tmp_path.glob("x.json*"))) == 1


def test_json_lines_and_transcripts(spark, tmp_path):
    lines = ['{"n": 1, "cmd": "a"}', "broken {", '{"n": 3, "cmd": "b"}', '{"n": 2, "cmd": "a"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = files.json_lines(spark, str(tmp_path / "log.jsonl"), "n long, cmd string", F.col("cmd") == "a")
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert [r.n for r in files.newest(files.json_lines(spark, str(tmp_path / "log.jsonl"), "n long, cmd string"), "n", 2).collect()] == [3, 2]
    rows = [json.dumps({"session_id": "s", "turn": 1, "message": {"role": "user", "content": "hi"}}), json.dumps({"conv_id": "t", "step": 2, "role": "tool", "tool": "search", "text": "x", "ts": "2024-01-01T00:00:00Z"}), "no json"]
    steps = files.transcripts(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert sorted((r.conv_id, r.step, r.role, r.tool, r.text) for r in steps) == [("s", 1, "user", None, "hi"), ("t", 2, "tool", "search", "x")]


def test_a_snapshot_vouches_for_itself(spark, tmp_path):
    state = spark.createDataFrame([("a", 1, 2, False), ("b", 1, 3, True)], changes.STATE)
    path = str(tmp_path / "s")
    assert files.load_snapshot(spark, path, changes.STATE).count() == 0
    files.save_snapshot(state, path)
    assert files.snapshot_summary(spark, path)["head"] == 3 and files.snapshot_summary(spark, path)["active"] == 1
    assert files.load_snapshot(spark, path, changes.STATE).count() == 2
    state.limit(1).write.mode("overwrite").parquet(f"{path}/1/rows")
    assert files.load_snapshot(spark, path, changes.STATE).count() == 0
    files.save_snapshot(state.unionByName(state), path)  # rows twice don't cancel
    two = files.snapshot_summary(spark, path)
    assert two["rows"] == 4 and two["checksum"] != files.summary_of(state.limit(0)).first()["checksum"]


def test_bundles(spark, tmp_path):
    s = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["b"])], "id long, spaces array<string>")
    files.write_bundles(s, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.space, r.id) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]


def test_index_versions_filters_and_boost(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, "PidController", "", "", "pid control loop", "h", "a/x", "f1"), (2, "app.motor::PID", "", "", "motor driver of pid", "cpp", "b", "f2"), (3, "Other", "f(pid)", "pid", "nothing here", "cpp", "b", "f3"), (4, None, None, None, None, None, None, None)]
    schema = "id long, name string, signature string, members string, docstring string, language string, space string, file_path string"
    lexical.write_index(spark.createDataFrame(rows, schema), path, parts=4, mark="one")
    got = [r.doc for r in lexical.search_index(spark, path, "pid").collect()]
    assert sorted(got) == [1, 2, 3] and got[0] == 2  # its last segment is the query
    assert [r.doc for r in lexical.search_index(spark, path, "pid", where=F.col("language") == "h").collect()] == [1]
    assert lexical.search_index(spark, path, "the of").collect() == [] and lexical.search_index(spark, path, "unknown").collect() == []
    assert lexical.search_index(spark, path, "unknown").schema == lexical.search_index(spark, path, "pid").schema
    both = {r.doc: r.score for r in lexical.search_index(spark, path, "pid pid control", limit=None).collect()}
    assert set(both) == {1}  # repeated terms count in the coverage: others have one distinct term of three
    fresh = spark.createDataFrame([(3, "Pid", "", "", "pid", "cpp", "b", "f3")], schema)
    lexical.patch_index(spark, path, spark.createDataFrame([(3,), (1,)], "doc long"), fresh, mark="two")
    assert [r.doc for r in lexical.search_index(spark, path, "pid").collect()][0] == 3
    assert scratch.pointer(spark, path) == {"version": 2, "mark": "two"}
    again = str(tmp_path / "again")
    lexical.write_index(spark.createDataFrame([rows[1], tuple(fresh.first()), rows[3]], schema), again, parts=4)
    plain = lambda p: [(r.doc, round(r.score, 9), r.matched) for r in lexical.search_index(spark, p, "motor pid").collect()]
    assert plain(path) == plain(again)


def test_every_space_gets_free_symbols(spark, tmp_path):
    s = spark.range(10_050).selectExpr("id", "array(concat('s', id)) AS spaces").unionByName(spark.createDataFrame([(99_999, [])], "id long, spaces array<string>"))
    own = s.where("size(spaces) > 0").select(F.explode("spaces").alias("s")).distinct()
    assert own.count() == 10_050
    few = spark.createDataFrame([(i, [f"s{i}"]) for i in range(30)] + [(99, [])], "id long, spaces array<string>")
    files.write_bundles(few, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("id = 99").count() == 30


def test_rotation_tail_and_siblings(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        files.append_json(spark.range(k * 10, k * 10 + 10), path, "id", 300, 12)
    assert 12 <= spark.read.json(path).count() <= 30 and spark.read.json(path).agg(F.max("id")).first()[0] == 39
    rows = spark.range(1, 6)
    assert files.tail(rows, "id", 3)[0].count() == 2 and files.tail(rows, "id", 9)[0].count() == 5
    assert files.tail(rows, "id", 3, "inode 2", "inode 1")[0].count() == 5
    names = spark.createDataFrame([("a.jsonl",), ("a_full.jsonl",), ("b.jsonl",)], "rel_path string")
    assert sorted(r.rel_path for r in files.full_siblings(names).collect()) == ["a_full.jsonl", "b.jsonl"]


def test_racily_clean_files_are_read_again(spark):
    before = spark.createDataFrame([("old", 1, 100, "h1"), ("racy", 1, 995_000_000, "h2"), ("grown", 1, 100, "h3")], "rel_path string, size long, mtime_ns long, content_hash string")
    now = spark.createDataFrame([("old", 1, 100), ("racy", 1, 995_000_000), ("grown", 2, 100), ("new", 1, 1)], "rel_path string, size long, mtime_ns long")
    assert {r.rel_path: r.content_hash for r in spaces.to_hash(before, now, 1_000_000_000).collect()} == {"old": "h1", "racy": None, "grown": None, "new": None}


def test_generations_follow_a_stream(spark, tmp_path):
    state, cursor, feed = str(tmp_path / "state"), str(tmp_path / "cursor"), str(tmp_path / "in")
    schema = "rel_path string, seq long, exists boolean"

    def step(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        changes.maintain(spark.readStream.schema(schema).parquet(feed), state, str(tmp_path / "checkpoint"), once=True).awaitTermination()

    reader = changes.Consumer(spark, "me", state, cursor)
    step(("a", 1, True), ("b", 2, True), ("b", 3, False), ("c", 4, True))
    with reader as new:
        assert sorted((r.rel_path, r.change) for r in new.collect()) == [("a", "added"), ("c", "added")]
    step(("a", 5, True), ("c", 6, False), ("zz", 7, False))
    try:
        with reader as new:
            assert sorted((r.rel_path, r.change) for r in new.collect()) == [("a", "modified"), ("c", "deleted")]
            raise RuntimeError
    except RuntimeError:
        pass
    assert reader.acked() == 1 and reader.head() == 2
    step(("c", 8, True))
    with reader as new:
        assert sorted((r.rel_path, r.change) for r in new.collect()) == [("a", "modified"), ("c", "added")]
    assert reader.acked() == 3


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.createDataFrame([("a", 1, True)], "rel_path string, seq long, exists boolean")
    assert changes.apply_changes(spark, rows, path, "q#0") == 1
    assert changes.apply_changes(spark, rows, path, "q#0") == 1  # replayed after it was named
    assert [(r.created_gen, r.updated_gen) for r in changes.read_state(spark, path).collect()] == [(1, 1)]
    assert changes.apply_changes(spark, rows, path, "q#1") == 2


def test_late_rows_and_fan_out(spark, tmp_path):
    feed = str(tmp_path / "in")
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 02:00:00"), ("v", "2024-01-01 00:05:00")]
    df = spark.createDataFrame(rows, "user string, t string").select("user", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(df.schema).parquet(feed)
    q = changes.event_sessions(stream, "user").writeStream.format("memory").queryName("own_sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user, r.events) for r in spark.table("own_sessions").collect()) == [("u", 2), ("v", 1)]
    seen = {}

    def bad(_):
        raise ValueError

    subscribers = {"all": (None, lambda d: seen.setdefault("all", d.count())), "bad": (None, bad), "v": (F.col("user") == "v", lambda d: seen.setdefault("v", d.count()))}
    changes.fan_out(spark.readStream.schema(df.schema).parquet(feed), subscribers, str(tmp_path / "c"), once=True).awaitTermination()
    assert seen == {"all": 4, "v": 1}
    assert changes.patch_or_rescan(df.withColumn("rel_path", F.col("user"))) == "patch"
