"""Directory trees as a data source, tables as files, and files written back.

A tree lists files, directories, empty directories and symbolic links (which are not followed); contents
come from Spark's own binaryFile reader, joined by path, so they can lie in any store that it reads.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomstone.sources.store import written

SCHEMA = "path string, entry_type string, size long, target string, permissions long, uid long, gid long, mtime timestamp, ctime timestamp"


def _entry(root: str, path: str) -> tuple:
    at = os.path.join(root, path) if path else root
    s = os.lstat(at)
    link = stat.S_ISLNK(s.st_mode)
    folder = stat.S_ISDIR(s.st_mode)
    kind = "symlink" if link else "file" if not folder else "directory" if os.listdir(at) else "empty_directory"
    when = lambda t: datetime.fromtimestamp(int(t), UTC)
    born = getattr(s, "st_birthtime", s.st_mtime)  # falls back to the time of change
    return (path or os.path.basename(root), kind, s.st_size if kind == "file" else None, os.readlink(at) if link else None, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, when(s.st_mtime), when(born))


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        """The entries at the top; each top directory is walked by a task of its own."""
        if not os.path.isdir(self.root) or os.path.islink(self.root):
            return [InputPartition(("", False))]
        return [InputPartition((name, True)) for name in sorted(os.listdir(self.root))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, deep = partition.value
        if first is None:
            return
        todo = [first]
        while todo:
            path = todo.pop()
            row = _entry(self.root, path)
            yield row
            if deep and row[1] == "directory":
                todo += [f"{path}/{n}" for n in sorted(os.listdir(os.path.join(self.root, path)), reverse=True)]


class FileTree(DataSource):
    """spark.read.format("loomstone_tree").load(path): paths are relative to the root, directories before what is in them."""

    @classmethod
    def name(cls) -> str:
        return "loomstone_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return _Reader(self.options["path"])


def scan_tree(spark: SparkSession, path: str) -> DataFrame:
    """All entries below a directory, or the single file itself. A missing path raises FileNotFoundError."""
    root = path.removeprefix("file://").rstrip("/") or "/"
    if not os.path.lexists(root):
        raise FileNotFoundError(path)
    spark.dataSource.register(FileTree)
    return spark.read.format("loomstone_tree").load(root)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The entries of scan_tree with ``content`` (binary; null for what is not a file)."""
    root = os.path.abspath(path.removeprefix("file://"))
    tree = scan_tree(spark, root)
    if not os.path.isdir(root):
        found = spark.read.format("binaryFile").load(f"file://{root}").select("content")
        return tree.crossJoin(F.broadcast(found))  # one file
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    inside = F.regexp_replace("path", "^file:/+", "/")
    found = found.select(F.substring(inside, len(root) + 2, 1 << 20).alias("_p"), "content")
    out = tree.join(found, F.col("path") == F.col("_p"), "left").drop("_p")
    return out.withColumn("content", F.when(F.col("entry_type") == "file", F.col("content")))


def table_as_files(df: DataFrame, path: Column, value: Column) -> DataFrame:
    """A table as files: path, content and the metadata columns of a tree (null where a table has none)."""
    content = value.cast("binary")
    return df.select(
        path.alias("path"), F.lit("file").alias("entry_type"), F.length(content).cast("long").alias("size"), F.lit(None).cast("string").alias("target"),
        F.lit(0o644).cast("long").alias("permissions"), F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("gid"),
        F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("timestamp").alias("ctime"), content.alias("content"),
    )


def buffer_as_file(spark: SparkSession, data: bytes, name: str = "buffer") -> DataFrame:
    return table_as_files(spark.createDataFrame([(name, bytearray(data))], "p string, v binary"), F.col("p"), F.col("v"))


def safe_path(path: str) -> bool:
    """Relative, without "..", empty or NUL parts."""
    return bool(path) and not path.startswith(("/", "\\")) and "\0" not in path and all(p not in ("", ".", "..") for p in path.replace("\\", "/").split("/"))


def is_safe(path: Column) -> Column:
    return F.coalesce(~path.rlike(r"(^|[/\\])(\.{0,2})([/\\]|$)") & (path != "") & (F.instr(path, "\0") == 0), F.lit(False))


def write_tree(files: DataFrame, out_dir: str, overwrite: bool = False) -> DataFrame:
    """Write entries (path, entry_type, content, target, permissions, mtime) below a directory that all
    executors share. Returns path, status. Directories come first, then files, links last, so nothing is ever
    written through a link; unsafe paths are refused ("unsafe"), existing files too unless overwrite."""
    root = os.path.abspath(out_dir.removeprefix("file://"))
    os.makedirs(root, exist_ok=True)

    def one(r: dict) -> str:
        path = r["path"]
        if not path or not safe_path(path):
            return "unsafe"
        at = os.path.join(root, path)
        parent = os.path.realpath(os.path.dirname(at))
        if parent != root and not parent.startswith(root + os.sep):
            return "unsafe"
        kind = r["entry_type"]
        if kind in ("directory", "empty_directory"):
            os.makedirs(at, exist_ok=True)
        elif kind == "symlink":
            target = os.path.normpath(os.path.join(os.path.dirname(path), r["target"] or ""))
            if os.path.isabs(r["target"] or "/") or target.startswith(".."):
                return "unsafe"
            os.makedirs(os.path.dirname(at), exist_ok=True)
            if os.path.lexists(at):
                if not overwrite:
                    return "exists"
                os.remove(at)
            os.symlink(r["target"], at)
        else:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            if os.path.islink(at) or os.path.exists(at) and not overwrite:
                return "exists"
            with open(at, "wb") as f:
                f.write(r["content"] or b"")
        if kind != "symlink":
            if r["permissions"] is not None and kind == "file":
                os.chmod(at, r["permissions"])
            if r["mtime"] is not None:
                os.utime(at, (r["mtime"].timestamp(),) * 2)
        return "ok"

    def write(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"] for r in rows], pa.string()), "status": pa.array([one(r) for r in rows], pa.string())})

    cols = ["path", "entry_type", "content", "target", "permissions", "mtime"]
    done = []
    for kinds in (("directory", "empty_directory"), ("file",), ("symlink",)):
        part = files.filter(F.col("entry_type").isin(*kinds)).select(*cols).mapInArrow(write, "path string, status string")
        done.append(written(part))
    return done[0].union(done[1]).union(done[2])

