"""What a task changed: one row a file with its diff, marks and kind, and one a task with counts and a fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import linediff
from lodeworks.functions.hashing import root_hash
from lodeworks.functions.paths import basename
from lodeworks.functions.text import has_conflict_marker
from lodeworks.operators.taskrules import LOCKFILES, MANIFESTS

#: A file with a NUL among its first bytes is binary, and a link to another repository has its own mode. Fixed values.
PROBE, SUBMODULE = 8000, "160000"


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, PROBE), F.lit(bytearray(b"\x00")))


def changed_files(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Each changed file with its flags, line counts and patch.

    changed: task_id, path, status, old_path, generated, mode (null if unknown). before, after: task_id, path, content
    (binary), each path at most once. A file is compared with the one at its old path, or at its own. A side that is
    missing or null is no file. Binary files and links to repositories have no lines, and generated files that aren't
    tracked have no patch; their counts are 0. Bytes that aren't UTF-8 become replacement characters. diff_lines counts
    the patch's lines with a sign, but for those that look like a file's heading. Files with a null task or path are
    listed without contents.
    """
    old = before.select("task_id", F.col("path").alias("_was"), F.col("content").alias("_old"))
    new = after.select("task_id", "path", F.col("content").alias("_new"))
    rows = changed.withColumn("_was", F.coalesce("old_path", "path"))
    rows = rows.join(new, ["task_id", "path"], "left").join(old, ["task_id", "_was"], "left")
    gone, fresh = F.col("status") == "deleted", F.col("status").isin("added", "untracked")
    rows = rows.withColumn("_new", F.when(~gone, F.col("_new"))).withColumn("_old", F.when(~fresh, F.col("_old")))
    rows = rows.withColumn("is_submodule", F.coalesce(F.col("mode") == SUBMODULE, F.lit(False)))
    rows = rows.withColumn("is_binary", F.coalesce(is_binary(F.col("_old")), F.lit(False)) | F.coalesce(is_binary(F.col("_new")), F.lit(False)))
    compared = ~F.col("is_submodule") & ~F.col("is_binary") & ~(F.col("generated") & (F.col("status") == "untracked"))
    read = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    marked = has_conflict_marker(read("_new")) & ~F.col("generated") & ~F.col("is_binary")
    rows = rows.withColumn("has_conflict", F.coalesce(marked, F.lit(False)))
    for side in ("_old", "_new"):
        rows = rows.withColumn(side, F.when(compared, linediff.lines(read(side))))
    rows = rows.withColumn("_hunks", linediff.hunks(F.col("_old"), F.col("_new")))
    body = linediff.patch(F.col("_hunks"), F.col("_old"), F.col("_new"))
    a, b = F.concat(F.lit("a/"), F.col("_was")), F.concat(F.lit("b/"), F.col("path"))
    none = F.lit("/dev/null")
    kind = (F.when(fresh, F.lit("new file mode 100644\n")).when(gone, "deleted file mode 100644\n")
            .when(F.col("old_path").isNotNull(), F.concat(F.lit("rename from "), F.col("_was"), F.lit("\nrename to "), F.col("path"), F.lit("\n"))).otherwise(""))
    names = F.concat(F.lit("--- "), F.when(fresh, none).otherwise(a), F.lit("\n+++ "), F.when(gone, none).otherwise(b), F.lit("\n"))
    text = F.concat(F.lit("diff --git "), a, F.lit(" "), b, F.lit("\n"), kind, F.when(body != "", F.concat(names, body)).otherwise(""))
    binary = F.concat(F.lit("Binary files "), F.when(fresh, none).otherwise(a), F.lit(" and "), F.when(gone, none).otherwise(b), F.lit(" differ\n"))
    rows = rows.withColumn("patch", F.when(compared, text).when(F.col("is_binary"), binary))
    name = basename(F.col("path"))
    # Only a patch's own two headings are lines with three signs, and lines of texts that begin with two more.
    signs = F.when(compared, F.regexp_count("patch", F.lit(r"(?m)^(\+(?!\+\+)|-(?!--))"))).otherwise(0)
    return rows.select(
        "task_id", "path", "old_path", "status", "generated", linediff.added(F.col("_hunks")).alias("added"), linediff.removed(F.col("_hunks")).alias("removed"),
        F.size("_hunks").cast("long").alias("hunks"), signs.cast("long").alias("diff_lines"), "is_binary", "is_submodule", "has_conflict",
        name.isin(*LOCKFILES).alias("is_lockfile"), name.isin(*MANIFESTS).alias("is_manifest"), "patch")


def inspected(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a task: counts of what isn't generated, lines of the diff, and a fingerprint of head, files and patches.

    files: rows of changed_files. tasks: task_id, head, baseline. A task without changed files has counts of 0 and no
    fingerprint; an unknown head doesn't match. Digests are folded level by level, so a task may have any number of files.
    files is read more than once: where diffs are many, write them first.
    """
    own = ~F.col("generated")
    tests = {
        "changed": F.lit(True), "n_added": F.col("status").isin("added", "untracked"), "n_modified": F.col("status") == "modified", "n_deleted": F.col("status") == "deleted",
        "n_renamed": F.col("status") == "renamed", "n_untracked": F.col("status") == "untracked", "n_binary": F.col("is_binary"), "n_conflicts": F.col("has_conflict"),
        "n_lockfiles": F.col("is_lockfile"), "n_manifests": F.col("is_manifest"), "n_submodules": F.col("is_submodule"),
    }
    counts = files.groupBy("task_id").agg(*(F.count_if(own & c).alias(k) for k, c in tests.items()), F.count_if("generated").alias("n_generated"), F.sum("diff_lines").alias("diff_lines"), F.bool_or(F.coalesce(F.col("patch") != "", F.lit(False))).alias("has_patch"))
    digest = F.sha2(F.concat_ws("\n", "status", F.sha2(F.coalesce("patch", F.lit("")), 256)), 256)
    prints = root_hash(files.filter(own & F.col("path").isNotNull()), "path", digest, by=["task_id"])
    rows = tasks.select("task_id", "head", "baseline").join(counts, "task_id", "left").join(prints, "task_id", "left")
    rows = rows.na.fill(0, [*tests, "n_generated", "diff_lines"]).na.fill(False, ["has_patch"])
    mark = F.when(F.col("root_hash").isNotNull(), F.sha2(F.concat_ws("\n", F.coalesce("head", F.lit("")), "root_hash"), 256))
    return rows.select("task_id", "head", F.coalesce(F.col("head") == F.col("baseline"), F.lit(False)).alias("head_matches"), *tests, "n_generated", "diff_lines", "has_patch", mark.alias("fingerprint"))
