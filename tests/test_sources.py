"""Sources, snapshots and streams on files of a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from lodeworks.operators.sequence import TASK_STATES
from lodeworks.sources import documents, files, snapshots
from lodeworks.streaming import history

C = F.col


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_bytes(b"\xef\xbb\xbfconst a = 1\n")
    (tmp_path / "src/中 b.md").write_bytes("# x\r\ny".encode())
    (tmp_path / "u16.txt").write_bytes(b"\xff\xfe" + "hi\n".encode("utf-16le"))
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\xff")
    (tmp_path / "big.txt").write_bytes(b"x" * (3 << 20))
    found = {r.path: r for r in files.scan_tree(spark, f"file://{tmp_path}", excludes=["bin.*"]).collect()}
    assert set(found) == {"src/a.ts", "src/中 b.md", "u16.txt", "bad.txt", "big.txt"}
    assert (found["src/a.ts"].encoding, found["src/a.ts"].text, found["src/a.ts"].category) == ("UTF-8 BOM", "const a = 1\n", "source")
    assert (found["src/中 b.md"].line_count, found["src/中 b.md"].category) == (2, "documentation")
    assert (found["u16.txt"].encoding, found["u16.txt"].text) == ("UTF-16LE", "hi\n")
    assert (found["bad.txt"].encoding, found["bad.txt"].is_text) == ("unknown", False)
    assert found["big.txt"].text is None and found["big.txt"].warnings


def test_porcelain(spark):
    status = spark.createDataFrame([("R  new.ts\0old.ts\0 M a b.ts\0?? u\0 D gone\0",)], "output string")
    assert sorted((r.path, r.status, r.old_path) for r in files.porcelain(status).collect()) == [("a b.ts", "modified", None), ("gone", "deleted", None), ("new.ts", "renamed", "old.ts"), ("u", "untracked", None)]


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/store", "k")
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "y")], "k int, v string")
    assert store.current() is None
    assert store.write(a, "s1") == "written"
    assert store.write(a.repartition(5), "s1") == "unchanged"
    with pytest.raises(FileExistsError):
        store.write(b, "s1")
    assert store.write(b, "s1", force=True) == "written"
    assert store.write(a, "s2") == "written" and store.current() == "s2" and store.valid("s2")
    assert store.read().count() == 2 and store.read("s1").first()["v"] == "y"
    assert snapshots.next_run_id(spark, spark.createDataFrame([("run-007",), ("x",)], "run_id string")) == "run-008"


def test_json_and_captures(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"seq": 1, "next_status": "draft"}\n{"seq": 2, "previous_status": "draft", "next_status": "validated"}\n')
    assert documents.read_history(spark, str(tmp_path / "h.jsonl")).count() == 2
    rows = spark.createDataFrame([('{"a": {"b": 5}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in rows.select(documents.json_value(C("j"), "$.a.b", "int")).collect()] == [5, None, None]
    tries = spark.createDataFrame([("u", 0, False), ("u", 1, True), ("v", 0, False), ("v", 1, False)], "url string, p int, good boolean")
    assert sorted((r.url, r.p) for r in documents.best_capture(tries, ["url"], C("good"), "p").collect()) == [("u", 1), ("v", 0)]


def test_history_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"task": "a", "seq": 1, "state": "draft"}, {"task": "a", "seq": 2, "state": "closed"}, {"task": "b", "seq": 1, "state": "draft"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = history.history_stream(spark, f"file://{source}", "task string, seq bigint, state string")
    bad = history.illegal_transitions(stream, "task", "state", "seq", TASK_STATES, ["draft"])
    run = bad.writeStream.format("memory").queryName("bad_moves").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("bad_moves").collect()] == [("a", 2, "draft", "closed")]


def test_object_ids_listings_and_event_logs(spark, rows):
    """Ids as version control gives them; listings with and without stages; texts with marks, with NULs and plain."""
    import hashlib

    contents = [b"", b"hello\n", bytes(range(256)) * 3]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c binary").select("i", files.blob_id(F.col("c"))).collect()
    assert sorted(map(tuple, found)) == [(i, hashlib.sha1(b"blob %d\0" % len(c) + c).hexdigest()) for i, c in enumerate(contents)]
    a, b = "a" * 40, "b" * 64
    listing = spark.createDataFrame([("\x00".join(["x y.ts", "src/b.ts", f"100644 {a} 0\tsrc/b.ts", f"100755 {b} 0\tw\\z.ts", ""]),), ("",)], "output string")
    tracked = files.listed_objects(listing)
    assert rows(tracked) == [("src/b.ts", "100644", a), ("w/z.ts", "100755", b), ("x y.ts", None, None)]
    assert rows(files.to_read(tracked, spark.createDataFrame([("src/b.ts", a), ("w/z.ts", a), ("x y.ts", None)], "path string, object_id string")).select("path")) == [("w/z.ts",), ("x y.ts",)]
    texts = [("é plain".encode(), "é plain"), (b"\xff\xfe" + "Aé\n".encode("utf-16-le"), "Aé\n"), ("wide text 漢".encode("utf-16-le"), "wide text 漢"), (b"\xef\xbb\xbfmarked", "marked"), (b"a\x00bcdefgh", "a\x00bcdefgh"), (b"", "")]
    found = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(texts)], "i int, c binary").select("i", files.event_text(F.col("c"))).collect()
    assert sorted(map(tuple, found)) == [(i, t) for i, (_, t) in enumerate(texts)]
