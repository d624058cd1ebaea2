"""Immutable snapshots with a pointer to the current one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.hashing import canonical_json, root_hash


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. On one machine a temporary one stands in for it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    root = root or "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for loops whose plans would grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def digest(df: DataFrame, key: str) -> str:
    """The root hash of a table's rows."""
    return root_hash(df, key, F.sha2(canonical_json(*df.columns), 256)).first()[0] or ""


def _at(spark: SparkSession, path: str):
    """A path, and the file system that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, source: str, target: str) -> None:
    (fs, a), (_, b) = _at(spark, source), _at(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


class SnapshotStore:
    """Snapshots of a table under root: snapshots/<id> and current."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, snapshot: str) -> str:
        return f"{self.root}/snapshots/{snapshot}"

    def write(self, df: DataFrame, snapshot: str, force: bool = False) -> str:
        """Write a snapshot and point to it: "written", or "unchanged" if it exists with the same root hash.

        Another root hash under the same id is refused unless force is set. Data are written beside and moved into place.
        """
        path, own = self._path(snapshot), digest(df, self.key)
        if exists(self.spark, path):
            if self.root_hash(snapshot) == own:
                return "unchanged"
            if not force:
                raise FileExistsError(f"snapshot {snapshot} exists with other content")
        df.write.mode("overwrite").parquet(f"{path}.new/data")
        self.spark.createDataFrame([(snapshot, own)], "snapshot string, root_hash string").coalesce(1).write.mode("overwrite").json(f"{path}.new/manifest")
        if exists(self.spark, path):
            # The old one is there, under one name or the other, until the new one is.
            _move(self.spark, path, f"{path}.{uuid.uuid4().hex}.old")
        _move(self.spark, f"{path}.new", path)
        self._point_to(snapshot)
        return "written"

    def _pointers(self) -> list[str]:
        fs, at = _at(self.spark, f"{self.root}/current")
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if not x.getPath().getName().endswith(".new")) if fs.exists(at) else []

    def _point_to(self, snapshot: str) -> None:
        """A new pointer under the next number, whole before it has its name; the last one counts."""
        number = int(self._pointers()[-1].split("-")[0]) + 1 if self._pointers() else 1
        fs, new = _at(self.spark, f"{self.root}/current/{uuid.uuid4().hex}.new")
        fs.create(new, False).close()
        _move(self.spark, str(new), f"{self.root}/current/{number:09d}-{snapshot}")

    def root_hash(self, snapshot: str) -> str:
        return self.spark.read.json(f"{self._path(snapshot)}/manifest", schema="snapshot string, root_hash string").first()["root_hash"]

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1].split("-", 1)[1] if pointers else None

    def read(self, snapshot: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._path(snapshot or self.current())}/data")

    def valid(self, snapshot: str) -> bool:
        """Whether the rows still have the root hash of the manifest."""
        return digest(self.read(snapshot), self.key) == self.root_hash(snapshot)


    def listed(self, check: bool = True) -> DataFrame:
        """(snapshot, root_hash, current, valid) of all snapshots; validity, if checked, is that of their rows now."""
        fs, at = _at(self.spark, f"{self.root}/snapshots")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        rows = [(n, self.root_hash(n), n == self.current(), self.valid(n) if check else None) for n in names if not n.endswith((".new", ".old"))]
        return self.spark.createDataFrame(rows, "snapshot string, root_hash string, current boolean, valid boolean")


class CollectionStore(SnapshotStore):
    """Snapshots of several tables that belong together: readers see all tables of one, or none.

    The tables are staged beside, with one manifest that names all and their root hashes; one move puts them in place, and
    the pointer comes last.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str]):
        """keys: each table's name, and its key column."""
        super().__init__(spark, root, "")
        self.keys = keys

    def write(self, tables: dict[str, DataFrame], snapshot: str, force: bool = False) -> str:
        """Write all tables as one snapshot and point to it: "written", or "unchanged" if it exists with the same content."""
        if set(tables) != set(self.keys):
            raise ValueError(f"a collection has the tables {sorted(self.keys)}")
        path, own = self._path(snapshot), {n: digest(df, self.keys[n]) for n, df in tables.items()}
        if exists(self.spark, path):
            if self.manifest(snapshot) == own:
                return "unchanged"
            if not force:
                raise FileExistsError(f"collection {snapshot} exists with other content")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}.new/{name}")
        self.spark.createDataFrame(sorted(own.items()), "name string, root_hash string").coalesce(1).write.mode("overwrite").json(f"{path}.new/manifest")
        if exists(self.spark, path):
            _move(self.spark, path, f"{path}.{uuid.uuid4().hex}.old")
        _move(self.spark, f"{path}.new", path)
        self._point_to(snapshot)
        return "written"

    def manifest(self, snapshot: str | None = None) -> dict[str, str]:
        """The tables of a collection and their root hashes."""
        rows = self.spark.read.json(f"{self._path(snapshot or self.current())}/manifest", schema="name string, root_hash string")
        return {r.name: r.root_hash for r in rows.collect()}

    def root_hash(self, snapshot: str) -> str:
        """One hash for all tables."""
        import hashlib

        return hashlib.sha256("\n".join(f"{n}:{h}" for n, h in sorted(self.manifest(snapshot).items())).encode()).hexdigest()

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of a collection, of the current one if none is named."""
        if name not in self.keys:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self._path(snapshot or self.current())}/{name}")

    def valid(self, snapshot: str) -> bool:
        """Whether all tables still have the root hashes of the manifest."""
        return all(digest(self.read(n, snapshot), self.keys[n]) == h for n, h in self.manifest(snapshot).items())


def append_history(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def next_run_id(spark: SparkSession, ids: DataFrame, column: str = "run_id", width: int = 3) -> str:
    """run-NNN after the largest number among the ids."""
    top = ids.agg(F.max(F.regexp_extract(column, r"^run-(\d+)$", 1).try_cast("long"))).first()[0]
    return f"run-{(top or 0) + 1:0{width}d}"
