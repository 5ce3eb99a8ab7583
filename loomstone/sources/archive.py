"""Archives as Parquet tables: manifest, file_index, blocks, chunks and volumes.

Written: files are classified, packed into blocks, cut into chunks across file boundaries, coded and, with a
password, encrypted. Tables go to a folder of their own inside the archive's; the manifest names it, is written last and is the
commit mark; a copy of it is written just before and serves if it is lost. So an archive that is replaced stays valid until the
new one is whole, and a job that is lost leaves the old one. Listing reads the index alone. Every payload has
checksums, from the file to the set.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.tokens import LEVELS
from loomstone.operators import codec, crypto, grouping, integrity, profile
from loomstone.sources import store
from loomstone.sources.store import written
from loomstone.timing import Phases

FORMAT, VERSION = "loomstone", 2
MANIFEST = (
    "format string, version int, archive_id string, level string, encrypted boolean, salt string, kdf_n int, kdf_r int, kdf_p int, sentinel binary, "
    "n_files long, original_size long, compressed_size long, n_blocks long, chunk_size long, volume_size long, set_digest string, folder string"
)


class ArchiveError(Exception):
    """Something is wrong with an archive."""


class NotAnArchive(ArchiveError):
    pass


class ArchiveExists(ArchiveError):
    pass


class Corrupt(ArchiveError):
    pass


class PasswordNeeded(ArchiveError):
    pass


class MissingVolume(ArchiveError):
    pass


@dataclass(frozen=True)
class Options:
    level: str = "balanced"
    password: str | None = None
    chunk_size: int = grouping.CHUNK_BYTES
    block_size: int = grouping.BLOCK_BYTES
    volume_size: int = 0
    overwrite: bool = False
    transpose: bool = True
    analysis: bool = False

    @staticmethod
    def of_session(spark: SparkSession, **given) -> Options:
        """Options from the session's settings: spark.loomstone.level, .transpose (false: no byte planes or channel
        splits are tried) and .analysis (true: the archive keeps a table of how its streams code)."""
        conf = lambda name, default: spark.conf.get(f"spark.loomstone.{name}", default)
        yes = lambda name, default: conf(name, default).lower() == "true"
        return Options(**{"level": conf("level", "balanced"), "transpose": yes("transpose", "true"), "analysis": yes("analysis", "false")} | given)

    def check(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"level: {self.level}; one of {', '.join(LEVELS)}")
        if not 0 < self.chunk_size <= self.block_size:
            raise ValueError("a chunk is at least one byte and at most a block")
        if self.volume_size and self.volume_size < self.chunk_size + 50:
            raise ValueError("a volume must hold a chunk and its header")
        if self.password is not None and not self.password:
            raise ValueError("an empty password")


def _chunks(files: DataFrame, chunk: int) -> DataFrame:
    """files (block_id, block_type, block_offset, size, content): block_id, block_type, chunk_no, chunk."""
    some = files.filter("size > 0")
    first, last = F.floor(F.col("block_offset") / chunk), F.floor((F.col("block_offset") + F.col("size") - 1) / chunk)
    pieces = some.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block_offset"), F.col("chunk_no") * chunk)
    stop = F.least(F.col("block_offset") + F.col("size"), (F.col("chunk_no") + 1) * chunk)
    part = F.col("content").substr((start - F.col("block_offset") + 1).cast("int"), (stop - start).cast("int"))
    pieces = pieces.select("block_id", "block_type", F.col("chunk_no").cast("long").alias("chunk_no"), start.alias("_at"), part.alias("_part"))

    def join(table: pa.Table) -> pa.Table:  # the pieces of one chunk
        table = table.sort_by("_at")
        row = table.slice(0, 1)
        data = b"".join(x.as_py() for x in table.column("_part"))
        return pa.table({n: row.column(n) for n in ("block_id", "block_type", "chunk_no")} | {"chunk": pa.array([data], pa.binary())})

    conf = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(int(conf), files.sparkSession.sparkContext.defaultParallelism)  # coding costs far more than small partitions
    dealt = pieces.repartition(n, "block_id", "chunk_no").groupBy("block_id", "chunk_no")
    return dealt.applyInArrow(join, "block_id long, block_type string, chunk_no long, chunk binary")


def existing(spark: SparkSession, path: str) -> list[str]:
    """What lies in an archive's folder, so what replacing it deletes. Empty if there is no such folder."""
    folder, system = store.folder_of(spark, path.rstrip("/"))
    return sorted(x.getPath().getName() for x in system.listStatus(folder)) if system.exists(folder) else []


def write_archive(files: DataFrame, path: str, options: Options | None = None, phases: Phases | None = None) -> DataFrame:
    """files: what read_files or table_as_files gives (path, entry_type, content and metadata).

    Returns the statistics, one row. Paths must be unique and safe. An archive that exists is only replaced
    with ``overwrite``; it is whole until the new manifest is there, and then its tables are deleted."""
    from loomstone.sources.tree import is_safe

    spark = files.sparkSession
    options = options or Options.of_session(spark)
    options.check()
    phases = phases or Phases()
    path, archive = path.rstrip("/"), uuid.uuid4().hex
    old = existing(spark, path)
    if old and not options.overwrite:
        raise ArchiveExists(f"{path} already exists: {', '.join(old)}")
    here = lambda name: f"{path}/{archive}/{name}"
    entries = files.withColumn("content", F.when(F.col("entry_type") == "file", F.coalesce("content", F.lit(b""))))
    bad = entries.agg(F.count_if(~is_safe(F.col("path"))).alias("unsafe"), (F.count("path") - F.countDistinct("path")).alias("twice")).first()
    if bad.unsafe or bad.twice:
        raise ValueError(f"{bad.unsafe} unsafe paths, {bad.twice} repeated ones")
    plain = entries.filter("entry_type = 'file'").withColumn("size", F.length("content").cast("long"))
    with phases("profile"):
        summed = integrity.checksums(plain, "content")
        kinds = profile.classify(plain.select("path", "content"), "content").select("path", "content_type", "pipeline", "block_type")
        placed = summed.drop("content").join(kinds.withColumnRenamed("path", "_k"), F.col("path") == F.col("_k")).drop("_k")
        placed = written(placed)  # metadata only: texts are read and profiled once
    with phases("pack"):
        placed = grouping.block_offsets(grouping.block_ids(grouping.pack_blocks(placed, options.block_size)))
        rest = entries.filter("entry_type <> 'file'").drop("content")
        index = written(placed.unionByName(rest, allowMissingColumns=True))
    whole = index.filter("entry_type = 'file'").select("path", "block_id", "block_type", "block_offset", "size")
    data = plain.select(F.col("path").alias("_p"), "content").join(whole, F.col("_p") == F.col("path")).drop("_p")
    coded = codec.encode(_chunks(data, options.chunk_size), "chunk", options.level, "block_type", options.transpose)
    kdf, key, check = None, None, None
    if options.password is not None:
        kdf = crypto.new_kdf()
        key = kdf.key(options.password)
        check = crypto.sentinel(spark, key, kdf.salt)
        coded = crypto.encrypt(coded, "payload", key, kdf.salt, ["block_id", "chunk_no"])
    coded = integrity.checksums(coded, "payload").withColumnsRenamed({"crc32": "payload_crc32", "sha256": "payload_sha256"})
    coded = coded.withColumn("coded_size", F.length("payload").cast("long"))
    with phases("code"):
        if options.volume_size:
            coded = written(coded)
            sizes = coded.groupBy("block_id").agg(F.sum("coded_size").alias("size"))
            volumes = written(grouping.volumes(sizes, options.volume_size))
            out = coded.join(volumes.select(F.col("block_id").alias("_b"), "volume_id"), F.col("block_id") == F.col("_b")).drop("_b")
            volumes.withColumn("archive_id", F.lit(archive)).write.parquet(here("volume_index"))
            out.write.partitionBy("volume_id").parquet(here("chunks"))
        else:
            coded.write.parquet(here("chunks"))
    with phases("index"):
        chunks = spark.read.parquet(here("chunks"))
        sums = [F.count(F.lit(1)).alias("n_chunks"), F.sum("raw_size").alias("raw_size"), F.sum("coded_size").alias("coded_size")]
        blocks = chunks.groupBy("block_id", "block_type").agg(*sums)
        blocks.write.parquet(here("blocks"))
        index.write.parquet(here("file_index"))
        if options.analysis:
            codec.stream_diagnostics(plain.select("content"), "content", options.level).write.parquet(here("analysis"))
    with phases("commit"):
        totals = index.agg(F.count_if(F.col("entry_type") == "file").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        coded_total = blocks.agg(F.coalesce(F.sum("coded_size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
        digest = integrity.table_digest(chunks, F.concat_ws(":", "block_id", "chunk_no"), F.col("payload_sha256")).first().digest
        row = (
            FORMAT, VERSION, archive, options.level, key is not None, kdf and kdf.salt, kdf and kdf.n, kdf and kdf.r, kdf and kdf.p, check,
            totals.n, totals.s, coded_total.s, coded_total.n, options.chunk_size, options.volume_size, digest, archive,
        )
        manifest = spark.createDataFrame([row], MANIFEST)
        for name in ("manifest_copy", "manifest"):  # one of them is whole at any time
            manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        for name in old:
            if name not in ("manifest", "manifest_copy"):
                store.delete(spark, f"{path}/{name}")
    return stats(manifest)


def stats(manifest: DataFrame) -> DataFrame:
    """ratio_x: original by compressed, higher is better; size_fraction: compressed by original."""
    o, c = F.col("original_size"), F.col("compressed_size")
    ratios = (o / F.nullif(c, F.lit(0))).alias("ratio_x"), (c / F.nullif(o, F.lit(0))).alias("size_fraction")
    return manifest.select("archive_id", "n_files", "n_blocks", "original_size", "compressed_size", "encrypted", *ratios)


class Reader:
    """An archive that is there. The manifest is read at once, everything else when asked for."""

    def __init__(self, spark: SparkSession, path: str, password: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        rows = []
        for name in ("manifest", "manifest_copy"):
            try:
                rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/{name}").collect()
            except Exception as e:  # the copy serves if the manifest is lost
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            if len(rows) == 1:
                break
        if len(rows) != 1 or rows[0].format != FORMAT:
            raise NotAnArchive(path)
        self.manifest = rows[0]
        if self.manifest.version != VERSION:
            raise ArchiveError(f"version {self.manifest.version} is not known here")
        self.key = None
        if self.manifest.encrypted and password is not None:
            m = self.manifest
            self.key = crypto.Kdf(m.salt, m.kdf_n, m.kdf_r, m.kdf_p).key(password)
            if not crypto.check_sentinel(spark, bytes(m.sentinel), self.key):
                raise crypto.WrongPassword("the password does not open this archive")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest.folder}/{name}")

    def info(self) -> DataFrame:
        return stats(self.spark.createDataFrame([self.manifest], MANIFEST))

    def index(self) -> DataFrame:
        return self.table("file_index")

    def list_files(self) -> DataFrame:
        return self.index().filter("entry_type = 'file'").select("path")

    def decompressed_size(self) -> DataFrame:
        return self.index().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("original_size"))

    def find(self, path: str) -> DataFrame:
        return self.index().filter(F.col("path") == path).limit(1)

    def missing(self) -> DataFrame:
        """Rows of the volume index whose volume is gone."""
        if not self.manifest.volume_size:
            return self.spark.createDataFrame([], "volume_id int, block_id long")
        here = self.table("chunks").select("volume_id").distinct()
        return grouping.missing_volumes(self.table("volume_index").select("volume_id", "block_id"), here)

    def volumes(self) -> DataFrame:
        """volume_id, archive_id, n_blocks, n_chunks, healthy: the volumes of the index, and whether all their chunks are
        there with the right checksums. An archive without volumes has none."""
        if not self.manifest.volume_size:
            return self.spark.createDataFrame([], "volume_id int, archive_id string, n_blocks long, n_chunks long, healthy boolean")
        good = F.col("payload_sha256").eqNullSafe(F.sha2("payload", 256)) & F.col("payload_crc32").eqNullSafe(F.crc32("payload"))
        here = self.table("chunks").groupBy("block_id").agg(F.count(F.lit(1)).alias("_n"), F.min(good.cast("int")).alias("_ok"))
        want = self.table("blocks").select("block_id", "n_chunks")
        both = self.table("volume_index").select("archive_id", "volume_id", "block_id").join(want, "block_id").join(here, "block_id", "left")
        fine = F.coalesce((F.col("_n") == F.col("n_chunks")) & (F.col("_ok") == 1) & (F.col("archive_id") == self.manifest.archive_id), F.lit(False))
        sums = F.count(F.lit(1)).alias("n_blocks"), F.sum("n_chunks").alias("n_chunks"), F.min(fine).alias("healthy")
        return both.groupBy("volume_id", "archive_id").agg(*sums)

    def _decoded(self, index: DataFrame) -> DataFrame:
        """block_id, chunk_no, value of the chunks that the index rows need."""
        if self.manifest.encrypted and self.key is None:
            raise PasswordNeeded(self.path)
        chunk = self.manifest.chunk_size
        first, last = F.floor(F.col("block_offset") / chunk), F.floor((F.col("block_offset") + F.col("size") - 1) / chunk)
        need = index.filter("size > 0").select(F.col("block_id").alias("_b"), F.explode(F.sequence(first, last)).alias("_n")).distinct()
        chunks = self.table("chunks")
        wanted = chunks.join(need, (F.col("block_id") == F.col("_b")) & (F.col("chunk_no") == F.col("_n")), "left_semi")
        bad = ~F.col("payload_sha256").eqNullSafe(F.sha2("payload", 256)) | ~F.col("payload_crc32").eqNullSafe(F.crc32("payload"))
        error = F.raise_error(F.concat(F.lit("corrupt chunk "), F.concat_ws(":", "block_id", "chunk_no")))
        wanted = wanted.withColumn("payload", F.when(bad, error).otherwise(F.col("payload")))
        slim = wanted.select("block_id", "chunk_no", "codec", "raw_size", "transform", "payload")
        if self.key is not None:
            slim = crypto.decrypt(slim, "payload", self.key, ["block_id", "chunk_no"])
        return codec.decode(slim)

    def read(self, where=None) -> DataFrame:
        """All entries, or those that meet a condition on the index, with ``content`` and ``status``
        ("ok", a mismatch, "missing_volume"; null for what is not a file)."""
        index = self.index() if where is None else self.index().filter(where)
        files = index.filter("entry_type = 'file'")
        chunk = self.manifest.chunk_size
        first, last = F.floor(F.col("block_offset") / chunk), F.floor((F.col("block_offset") + F.col("size") - 1) / chunk)
        spans = files.filter("size > 0").withColumn("_n", F.explode(F.sequence(first, last)))
        spans = spans.select("path", F.col("block_id").alias("_b"), "_n", "block_offset", "size")
        got = self._decoded(files)
        hit = spans.join(got, (F.col("_b") == F.col("block_id")) & (F.col("_n") == F.col("chunk_no")))
        start = F.greatest(F.col("block_offset"), F.col("chunk_no") * chunk)
        stop = F.least(F.col("block_offset") + F.col("size"), (F.col("chunk_no") + 1) * chunk)
        part = F.col("value").substr((start - F.col("chunk_no") * chunk + 1).cast("int"), (stop - start).cast("int"))
        pieces = hit.select("path", F.col("chunk_no").alias("at"), part.alias("part"))

        def join(table: pa.Table) -> pa.Table:  # the pieces of one file
            table = table.sort_by("at")
            return pa.table({"_p": table.column("path").slice(0, 1), "content": pa.array([b"".join(x.as_py() for x in table.column("part"))], pa.binary())})

        values = pieces.groupBy("path").applyInArrow(join, "_p string, content binary")
        out = index.join(values, F.col("path") == F.col("_p"), "left").drop("_p")
        content = F.when(F.col("entry_type") == "file", F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("content")))
        out = out.withColumn("content", content)
        short = F.col("content").isNull() | (F.length("content") < F.col("size"))
        check = integrity.verdict(F.crc32("content"), F.col("crc32"), F.sha2("content", 256), F.col("sha256"))
        return out.withColumn("status", F.when(F.col("entry_type") != "file", F.lit(None)).when(short, "missing_volume").otherwise(check))

    def verify(self) -> DataFrame:
        """status, n over all files, after the digest of the whole set was checked."""
        digest = integrity.table_digest(self.table("chunks"), F.concat_ws(":", "block_id", "chunk_no"), F.sha2("payload", 256)).first().digest
        if digest != self.manifest.set_digest and not self.missing().count():
            raise Corrupt(f"{self.path}: the set's digest differs")
        return self.read().filter("entry_type = 'file'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
