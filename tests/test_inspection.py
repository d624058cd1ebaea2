"""Line diffs against all alignments and against version control, and what a task changed."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import linediff
from lodeworks.operators import inspection, taskrules
from lodeworks.sources import files

C = F.col


def common(a, b):
    """The length of a longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_edits_are_fewest_and_rebuild_the_text():
    rng = random.Random(3)
    for n in range(600):
        a = [rng.choice("abcdefgh"[: 2 + n % 7]) for _ in range(rng.randrange(0, 40))]
        b = [rng.choice("abcdefgh"[: 2 + n % 7]) for _ in range(rng.randrange(0, 40))] if n % 2 else [x for x in a if rng.random() > 0.2]
        found, out, at = linediff.edits(a, b), [], 0
        for i, gone, j, new in found:
            out += a[at:i]
            assert len(out) == j
            out += b[j : j + new]
            at = i + gone
        assert out + a[at:] == b
        assert sum(x[1] for x in found) == len(a) - common(a, b)
        assert sum(x[3] for x in found) == len(b) - common(a, b)


def test_large_files():
    a = [f"{k % 997}" for k in range(30000)]
    b = [x for k, x in enumerate(a) if k % 10 != 3]
    assert sum(x[1] for x in linediff.edits(a, b)) == 3000 and sum(x[3] for x in linediff.edits(a, b)) == 0


TEXTS = [
    (None, "a\nb\n"), ("a\nb\n", None), ("", "x"), ("x", "x\n"), ("x\n", "x"), ("a\nb\nc", "a\nc"), ("same\n", "same\n"), ("\n\n", "\n"), ("a\r\nb\r\n", "a\nb\n"), (None, None),
    ("".join(f"{k}\n" for k in range(40)), "".join(f"{k}\n" if k not in (3, 9, 17, 39) else f"new {k}\n" for k in range(40))),
    ("中\n-- x\n", "文\n++ y\n"), ("one\ntwo", "one\ntwo\nthree"), ("a\n" * 50, "a\n" * 48 + "b\n"),
]


def diffed(spark):
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "k int, a string, b string").withColumn("o", linediff.lines(C("a"))).withColumn("n", linediff.lines(C("b")))
    rows = rows.withColumn("h", linediff.hunks(C("o"), C("n")))
    return {r.k: r for r in rows.select("k", "a", "b", "h", linediff.added(C("h")).alias("added"), linediff.removed(C("h")).alias("removed"), linediff.patch(C("h"), C("o"), C("n")).alias("patch")).collect()}


def test_patch_text(spark):
    got = diffed(spark)
    assert got[0].patch == "@@ -0,0 +1,2 @@\n+a\n+b\n" and got[1].patch == "@@ -1,2 +0,0 @@\n-a\n-b\n"
    assert got[2].patch == "@@ -0,0 +1 @@\n+x\n\\ No newline at end of file\n"
    assert got[3].patch == "@@ -1 +1 @@\n-x\n\\ No newline at end of file\n+x\n"
    assert got[5].patch == "@@ -1,3 +1,2 @@\n a\n-b\n c\n\\ No newline at end of file\n"
    assert [got[k].patch for k in (6, 9)] == ["", ""]
    assert [(h.old, h.old_lines) for h in got[10].h] == [(0, 13), (14, 7), (36, 4)]
    assert (got[10].added, got[10].removed) == (4, 4)


@pytest.mark.skipif(not shutil.which("git"), reason="no version control here")
def test_patches_apply(spark, tmp_path):
    for k, r in diffed(spark).items():
        if r.a is None or r.b is None or not r.patch:
            continue
        (tmp_path / "f").write_bytes(r.a.encode())
        full = f"diff --git a/f b/f\n--- a/f\n+++ b/f\n{r.patch}"
        subprocess.run(["git", "apply", "--whitespace=nowarn", "-"], input=full.encode(), cwd=tmp_path, check=True)
        assert (tmp_path / "f").read_bytes() == r.b.encode(), k


def test_porcelain_by_task_without_ignored_files(spark):
    status = spark.createDataFrame([("t1", "R  new\0old\0!! dist/x\0"), ("t2", " M a\0?? b\0")], "task_id string, output string")
    got = sorted((r.task_id, r.path, r.status, r.old_path) for r in files.porcelain(status, by=["task_id"]).collect())
    assert got == [("t1", "new", "renamed", "old"), ("t2", "a", "modified", None), ("t2", "b", "untracked", None)]


CHANGED = "task_id string, path string, status string, old_path string, generated boolean, mode string"
CONTENT = "task_id string, path string, content binary"


def inspect(spark, rows, before, after):
    frames = [spark.createDataFrame(x, s) for x, s in ((rows, CHANGED), (before, CONTENT), (after, CONTENT))]
    return inspection.changed_files(*frames)


def test_changed_files(spark):
    rows = [
        ("t", "src/a.ts", "modified", None, False, None), ("t", "src/new.ts", "renamed", "src/old.ts", False, None), ("t", "pic.png", "modified", None, False, None), ("t", "dist/o.js", "untracked", None, True, None),
        ("t", "package.json", "deleted", None, False, None), ("t", "x/yarn.lock", "added", None, False, None), ("t", "lib", "modified", None, False, "160000"), ("t", "lost", "modified", None, False, None), (None, None, "modified", None, False, None),
    ]
    before = [("t", "src/a.ts", b"1\n2\n3\n"), ("t", "src/old.ts", b"x\ny\n"), ("t", "pic.png", b"\x89\x00"), ("t", "package.json", b"{}\n"), ("u", "src/a.ts", b"other")]
    after = [("t", "src/a.ts", b"1\n<<<<<<< ours\n3\n\xff\n"), ("t", "src/new.ts", b"x\nz\n"), ("t", "pic.png", b"\x89\x00\x01"), ("t", "dist/o.js", b"<<<<<<< x\n"), ("t", "x/yarn.lock", b"l"), ("t", "package.json", b"stale\n")]
    got = {r.path: r for r in inspect(spark, rows, before, after).collect()}
    assert len(got) == 9
    r = got["src/a.ts"]
    assert (r.added, r.removed, r.diff_lines, r.has_conflict, r.hunks) == (2, 1, 3, True, 1) and "+�\n" in r.patch
    r = got["src/new.ts"]
    assert r.patch == "diff --git a/src/old.ts b/src/new.ts\nrename from src/old.ts\nrename to src/new.ts\n--- a/src/old.ts\n+++ b/src/new.ts\n@@ -1,2 +1,2 @@\n x\n-y\n+z\n"
    assert got["pic.png"].is_binary and got["pic.png"].patch.startswith("Binary files a/pic.png") and got["pic.png"].diff_lines == 0
    assert got["dist/o.js"].patch is None and not got["dist/o.js"].has_conflict
    assert (got["package.json"].removed, got["package.json"].is_manifest, got["x/yarn.lock"].is_lockfile, got["x/yarn.lock"].added) == (1, True, True, 1)
    assert got["lib"].is_submodule and got["lib"].patch is None
    assert (got["lost"].added, got["lost"].hunks, got[None].added) == (0, 0, 0)


def test_inspected_and_policy(spark):
    rows = [("t", "a", "modified", None, False, None), ("t", "b", "untracked", None, False, None), ("t", "d/g", "untracked", None, True, None), ("u", "a", "modified", None, False, None)]
    before, after = [("t", "a", b"1\n"), ("u", "a", b"1\n")], [("t", "a", b"2\n"), ("t", "b", b"n\n"), ("t", "d/g", b"g\n"), ("u", "a", b"2\n")]
    tasks = spark.createDataFrame([("t", "c1", "c1"), ("u", "c2", "c1"), ("none", None, "c1")], "task_id string, head string, baseline string")
    found = inspect(spark, rows, before, after)
    got = {r.task_id: r for r in inspection.inspected(found, tasks).collect()}
    t = got["t"]
    assert (t.changed, t.n_added, t.n_modified, t.n_untracked, t.n_generated, t.diff_lines, t.head_matches, t.has_patch) == (2, 1, 1, 1, 1, 3, True, True)
    assert (got["none"].changed, got["none"].fingerprint, got["none"].head_matches, got["u"].head_matches) == (0, None, False, False)
    again = inspect(spark, rows[::-1], before, [("t", "a", b"2\n"), ("t", "b", b"m\n"), ("u", "a", b"2\n")])
    other = {r.task_id: r.fingerprint for r in inspection.inspected(again, tasks).collect()}
    assert other["u"] == got["u"].fingerprint and other["t"] != t.fingerprint
    policy = spark.createDataFrame([("t", ["**"], [], [], [], 5, 5, 5, 2, True, True, True, True, True)], "task_id string, allowed array<string>, denied array<string>, allowed_untracked array<string>, denied_extensions array<string>, max_changed int, max_added int, max_deleted int, max_diff_lines int, allow_untracked boolean, lockfiles_read_only boolean, manifests_read_only boolean, no_conflict_markers boolean, require_patch boolean")
    failed = {r.rule for r in taskrules.policy_rules(policy, found, inspection.inspected(found, tasks)).collect() if not r.passed}
    assert failed == {"max-diff-lines", "untracked-files"}


def test_no_files(spark):
    found = inspect(spark, [], [], [])
    assert found.collect() == []
    tasks = spark.createDataFrame([("t", "c", "c")], "task_id string, head string, baseline string")
    assert [(r.changed, r.fingerprint) for r in inspection.inspected(found, tasks).collect()] == [(0, None)]
