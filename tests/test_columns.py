import pytest
from pyspark.sql import functions as F

from loomstone.functions import columns as C
from loomstone.functions import tokens

PE = bytearray(b"MZ" + b"\0" * 200)
PE[0x3C:0x40] = (100).to_bytes(4, "little")
PE[100:104] = b"PE\0\0"
ELF = b"\x7fELF\x02\x01" + b"\0" * 12 + b"\x3e\x00" + b"\0" * 20


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (None, None), (b"", "unknown"), (b"MZ", "pe"), (b"\x7fELF", "elf"), (b"\xfe\xed\xfa\xce", "macho"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF89a", "gif"), (b"BM", "bmp"),
        (b"RIFF0000WEBP", "webp"), (b"RIFF0000WAVE", "wav"), (b"RIFF0000AVI ", "avi"), (b"RIFF0000none", "ascii"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\0", "xz"),
        (b"\x28\xb5\x2f\xfd", "zstd"), (b"Rar!\x1a\x07\x00", "rar"), (b"%PDF", "pdf"), (b"ID3", "mp3"), (b"\xff\xfb", "mp3"), (b"fLaC", "flac"), (b"\xff\xf1", "aac"), (b"OggS", "ogg"), (b"\0\0\0\0ftyp", "mp4"),
        (b"\x1a\x45\xdf\xa3", "mkv"), (b"plain text\n", "ascii"), ("né".encode(), "utf8"), ("é".encode(), "utf8"), (b"\xc3", "unknown"), (b"a\xff\xff", "utf8"), (b"\x80abc", "unknown"), (b"a\0b", "unknown"),
        (b"\x01\x02", "utf8"), (b"x" * 300 + b"\xff", "ascii"), (b"\xed\xa0\x80", "unknown"), ("😀".encode(), "utf8"),
    ],
)
def test_signature(spark, data, want):
    df = spark.createDataFrame([(bytearray(data) if data is not None else None,)], "v binary")
    assert df.select(C.signature(F.col("v"))).first()[0] == want


def test_programs(spark):
    rows = [(1, PE, True), (2, PE[:50], False), (3, PE[:102], False), (4, ELF, True), (5, ELF[:19], False), (6, ELF[:18] + b"\x28\x00" + b"\0" * 9, False), (7, b"\xcf\xfa\xed\xfe\x07\x00\x00\x01", True), (8, b"\xfe\xed\xfa\xce\x00\x00\x00\x07", True), (9, b"\xcf\xfa\xed\xfe\x0c\x00\x00\x01", False), (10, b"", False), (11, None, False)]
    df = spark.createDataFrame([(i, bytearray(v) if v is not None else None, w) for i, v, w in rows], "i int, v binary, w boolean")
    assert df.filter(C.is_x86_program(F.col("v")) != F.col("w")).count() == 0


def test_routing(spark):
    rows = [
        ("png", 7.5, None, False, 100, "incompressible", 0.95), ("png", 6.0, None, False, 100_000, "binary", 0.8), ("mp4", 7.0, None, False, 100_000, "incompressible", 0.9), ("zip", 1.0, None, False, 100_000, "incompressible", 0.95),
        ("unknown", 7.96, None, False, 100_000, "incompressible", 0.99), ("unknown", 7.95, None, False, 100_000, "binary", 0.5), ("unknown", 5.0, 4, False, 100_000, "multimedia", 0.85), ("wav", 5.0, None, False, 100, "multimedia", 0.95),
        ("ascii", 5.0, 3, False, 100_000, "text", 0.9), ("pdf", 4.0, None, False, 100_000, "text", 0.9), ("pe", 7.0, None, False, 100_000, "binary", 0.8), ("unknown", 3.0, None, False, 100_000, "binary", 0.5), ("zip", 7.99, None, True, 10, "executable", 0.95),
    ]
    df = spark.createDataFrame(rows, "s string, e double, k int, p boolean, n long, want string, sure double")
    got = df.withColumn("r", C.routing(F.col("s"), F.col("e"), F.col("k"), F.col("p"), F.col("n")))
    assert [(r.r.content_type, r.r.confidence) for r in got.collect()] == [(r[5], r[6]) for r in rows]
    kinds = got.select(C.block_type(F.col("r.content_type"), F.col("r.pipeline")).alias("b")).collect()
    assert kinds[0].b == "raw" and kinds[-1].b == "binary"


@pytest.mark.parametrize(("password", "want"), [("short", "weak"), ("abcdefgh", "weak"), ("Abcdefg1", "moderate"), ("abcdefghijkl", "moderate"), ("Abcdefghijk1", "strong"), ("a" * 20, "very_strong"), ("ÄÖüß1234", "strong"), (None, None)])
def test_password(spark, password, want):
    assert spark.createDataFrame([(password,)], "p string").select(C.password_strength(F.col("p"))).first()[0] == want


def test_extension(spark):
    rows = [("a/b.txt", "txt"), ("a.d/b", None), (".hidden", None), ("x.tar.gz", "gz"), ("x.", ""), ("b", None)]
    df = spark.createDataFrame(rows, "p string, w string")
    assert [(r.p, r.e) for r in df.select("p", C.extension(F.col("p")).alias("e")).collect()] == rows


def test_slots(spark):
    got = spark.range(1, 5000).select("id", C.distance_slot(F.col("id")).alias("s")).collect()
    assert all(tuple(r.s) == tokens.distance_slot(r.id) for r in got)
    far = [2**k + j for k in range(13, 27) for j in (-1, 0, 1)]
    got = spark.createDataFrame([(x,) for x in far], "id long").select("id", C.distance_slot(F.col("id")).alias("s")).collect()
    assert all(tuple(r.s) == tokens.distance_slot(r.id) for r in got)
