"""Builders for archives."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources import archive as A
from loomstone.sources import tree
from loomstone.timing import Phases


class Compress:
    """Archive.write(spark, source).output(path).level("maximum").password("...").verify().run()"""

    def __init__(self, spark: SparkSession, source: DataFrame | str | bytes) -> None:
        self._spark, self._source = spark, source
        self._options, self._out, self._verify, self._progress = A.Options.of_session(spark), None, False, None
        self.phases = Phases()

    def _with(self, **kw) -> Compress:
        self._options = replace(self._options, **kw)
        return self

    def output(self, path: str) -> Compress:
        self._out = path
        return self

    def level(self, name: str) -> Compress:
        return self._with(level=name)

    def password(self, text: str | None) -> Compress:
        return self._with(password=text)

    def chunk_size(self, n: int) -> Compress:
        return self._with(chunk_size=n)

    def block_size(self, n: int) -> Compress:
        return self._with(block_size=n)

    def volume_size(self, n: int) -> Compress:
        return self._with(volume_size=n)

    def overwrite(self, yes: bool = True) -> Compress:
        return self._with(overwrite=yes)

    def verify(self, yes: bool = True) -> Compress:
        self._verify = yes
        return self

    def transpose(self, yes: bool) -> Compress:
        """Whether byte planes, channel splits and other transforms are tried."""
        return self._with(transpose=yes)

    def analysis(self, yes: bool = True) -> Compress:
        """Keep a table of how the streams of all files code: Archive.read(...).analysis()."""
        return self._with(analysis=yes)

    def on_progress(self, f) -> Compress:
        """f(done, total, path) for each file of the archive, in bytes, when all of them are committed; before that f(0, total, step)
        after each step. Files come to the driver one partition at a time, without their contents."""
        self._progress = f
        return self

    def timings(self) -> DataFrame:
        """phase, seconds, share of the last run."""
        return self.phases.report(self._spark)

    def run(self) -> DataFrame:
        """Statistics, one row; with verify() the archive is read back and checked first."""
        if self._out is None:
            raise ValueError("output() is needed")
        tell = self._progress or (lambda *a: None)
        self.phases = Phases()
        files = self._source
        if isinstance(files, bytes):
            files = tree.buffer_as_file(self._spark, files)
        elif isinstance(files, str):
            with self.phases("scan"):
                files = tree.read_files(self._spark, files)
        tell(0, None, "scanned")
        out = A.write_archive(files, self._out, self._options, self.phases)
        total = out.first().original_size
        tell(0, total, "written")
        if self._verify:
            with self.phases("verify"):
                found = {r.status: r.n for r in A.Reader(self._spark, self._out, self._options.password).verify().collect()}
            if set(found) - {"ok"}:
                raise A.Corrupt(f"{self._out}: {found}")
            tell(0, total, "verified")
        if self._progress:
            done = 0
            for r in A.Reader(self._spark, self._out).index().filter("entry_type = 'file'").select("path", "size").toLocalIterator():
                done += r["size"]
                tell(done, total, r.path)
        return out


class Extract:
    """Archive.read(spark, path).password("...").run() is a DataFrame; .output(dir) writes files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path
        self._password = self._out = self._where = None
        self._overwrite = False

    def password(self, text: str | None) -> Extract:
        self._password = text
        return self

    def output(self, path: str, overwrite: bool = False) -> Extract:
        self._out, self._overwrite = path, overwrite
        return self

    def where(self, condition: Column | str) -> Extract:
        """Only entries whose index row meets a condition; other chunks are not read."""
        self._where = condition
        return self

    def _reader(self) -> A.Reader:
        return A.Reader(self._spark, self._path, self._password)

    def read_metadata(self) -> DataFrame:
        return self._reader().info()

    def list_files(self) -> DataFrame:
        return self._reader().list_files()

    def verify(self) -> DataFrame:
        return self._reader().verify()

    def analysis(self) -> DataFrame:
        """How the streams of all files code, if the archive was written with analysis()."""
        return self._reader().table("analysis")

    def run(self) -> DataFrame:
        """Entries with content and status; with output() path and status of every entry: "ok" or "exists" or "unsafe" for
        what was or could have been written, and of files that could not be read back the reason ("crc_mismatch",
        "sha256_mismatch", "missing_volume" and the like), which are not written."""
        found = self._reader().read(self._where)
        if self._out is None:
            return found
        fine = F.col("status").isNull() | (F.col("status") == "ok")
        done = tree.write_tree(found.filter(fine), self._out, self._overwrite)
        return done.unionByName(found.filter(~fine).select("path", "status"))


class Archive:
    @staticmethod
    def write(spark: SparkSession, source: DataFrame | str | bytes) -> Compress:
        return Compress(spark, source)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Extract:
        return Extract(spark, path)
