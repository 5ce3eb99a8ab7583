import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.api import Archive
from loomstone.operators.crypto import WrongPassword
from loomstone.sources import archive as A
from loomstone.sources import tree


def inside(out):
    """The folder of the tables of an archive."""
    (found,) = [d for d in os.listdir(out) if not d.startswith("manifest")]
    return f"{out}/{found}"


def make_tree(root):
    rng = np.random.default_rng(42)
    os.makedirs(root / "sub/deep")
    os.makedirs(root / "empty")
    (root / "a.txt").write_bytes(b"hello " * 1000)
    (root / "ramp.bin").write_bytes(bytes(range(250)) * 4)
    (root / "sub/noise").write_bytes(rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes())
    (root / "sub/deep/zero").write_bytes(b"")
    (root / "sub/wave.dat").write_bytes(np.sin(np.arange(20_000) / 50).astype("<f4").tobytes())
    os.symlink("../a.txt", root / "sub/link")
    os.chmod(root / "a.txt", 0o640)
    os.utime(root / "a.txt", (1_000_000_000, 1_000_000_000))
    return root


def contents(root):
    out = {}
    for d, dirs, files in os.walk(root):
        for n in dirs + files:
            p = os.path.join(d, n)
            rel = os.path.relpath(p, root)
            out[rel] = ("link", os.readlink(p)) if os.path.islink(p) else ("dir",) if os.path.isdir(p) else ("file", open(p, "rb").read())
    return out


def test_scan(spark, tmp_path):
    root = make_tree(tmp_path / "in")
    rows = {r.path: r for r in tree.read_files(spark, str(root)).collect()}
    assert set(rows) == set(contents(root))
    assert rows["empty"].entry_type == "empty_directory" and rows["sub"].entry_type == "directory"
    assert rows["sub/link"].entry_type == "symlink" and rows["sub/link"].target == "../a.txt" and rows["sub/link"].content is None
    assert rows["a.txt"].permissions == 0o640 and rows["a.txt"].size == 6000 and bytes(rows["a.txt"].content) == b"hello " * 1000
    one = tree.read_files(spark, str(root / "a.txt")).collect()
    assert len(one) == 1 and one[0].path == "a.txt" and len(one[0].content) == 6000
    with pytest.raises(FileNotFoundError):
        tree.scan_tree(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("options", [{}, {"password": "secret words"}, {"volume_size": 40_000, "block_size": 30_000}, {"level": "maximum"}])
def test_directory_round_trip(spark, tmp_path, options):
    root = make_tree(tmp_path / "in")
    out = str(tmp_path / "archive")
    w = Archive.write(spark, str(root)).output(out).chunk_size(20_000).verify()
    for k, v in options.items():
        w = getattr(w, k)(v)
    seen = []
    stats = w.on_progress(lambda *a: seen.append(a)).run().first()
    size = sum(len(v[1]) for v in contents(root).values() if v[0] == "file")
    assert stats.n_files == 5 and stats.original_size == size
    assert [x[2] for x in seen[:3]] == ["scanned", "written", "verified"] and len(seen) == 8
    assert seen[-1][:2] == (size, size) and {x[2] for x in seen[3:]} == {"a.txt", "ramp.bin", "sub/deep/zero", "sub/noise", "sub/wave.dat"}
    timings = {r.phase: r.seconds for r in w.timings().collect()}
    assert list(timings) == ["scan", "profile", "pack", "code", "index", "commit", "verify"] and min(timings.values()) > 0
    r = Archive.read(spark, out).password(options.get("password"))
    assert sorted(x.path for x in r.list_files().collect()) == ["a.txt", "ramp.bin", "sub/deep/zero", "sub/noise", "sub/wave.dat"]
    status = r.output(str(tmp_path / "back")).run().collect()
    assert {x.status for x in status} == {"ok"}
    assert contents(tmp_path / "back") == contents(root)
    assert os.stat(tmp_path / "back/a.txt").st_mtime == 1_000_000_000 and os.stat(tmp_path / "back/a.txt").st_mode & 0o777 == 0o640
    only = Archive.read(spark, out).password(options.get("password")).where("path = 'a.txt'").run().collect()
    assert [(x.path, bytes(x.content), x.status) for x in only] == [("a.txt", b"hello " * 1000, "ok")]


def files(spark, n=40):
    rows = [(f"d{i % 3}/f{i}", bytearray(b"some text number %d " % i * (i * 7 % 50))) for i in range(n)]
    return tree.table_as_files(spark.createDataFrame(rows, "p string, v binary"), F.col("p"), F.col("v"))


def test_passwords(spark, tmp_path):
    out = str(tmp_path / "x")
    Archive.write(spark, files(spark)).output(out).password("right").run()
    with pytest.raises(WrongPassword):
        Archive.read(spark, out).password("wrong").run()
    with pytest.raises(A.PasswordNeeded):
        Archive.read(spark, out).run()
    assert Archive.read(spark, out).list_files().count() == 40  # the index is not encrypted
    assert Archive.read(spark, out).read_metadata().first().encrypted


def test_existing_and_options(spark, tmp_path):
    out = str(tmp_path / "x")
    Archive.write(spark, b"a buffer").output(out).run()
    assert bytes(Archive.read(spark, out).run().first().content) == b"a buffer"
    with pytest.raises(A.ArchiveExists, match="already exists"):
        Archive.write(spark, b"another").output(out).run()
    Archive.write(spark, b"another").output(out).overwrite().run()
    assert bytes(Archive.read(spark, out).run().first().content) == b"another"
    for bad in ({"level": "x"}, {"chunk_size": 0}, {"volume_size": 10}, {"password": ""}):
        with pytest.raises(ValueError):
            A.Options(**bad).check()
    with pytest.raises(ValueError):
        Archive.write(spark, b"x").run()
    with pytest.raises(A.NotAnArchive):
        Archive.read(spark, str(tmp_path / "none")).list_files()


def test_tampering(spark, tmp_path):
    out = str(tmp_path / "x")
    Archive.write(spark, files(spark)).output(out).chunk_size(500).run()
    out_tables = inside(out)
    chunks = spark.read.parquet(f"{out_tables}/chunks")
    flipped = chunks.withColumn("payload", F.when((F.col("block_id") == 0) & (F.col("chunk_no") == 1), F.concat(F.col("payload"), F.lit(b"!"))).otherwise(F.col("payload")))
    flipped.write.parquet(str(tmp_path / "bad"))
    os.rename(f"{out_tables}/chunks", tmp_path / "old")
    os.rename(tmp_path / "bad", f"{out_tables}/chunks")
    with pytest.raises(A.Corrupt):
        Archive.read(spark, out).verify()
    with pytest.raises(Exception, match="corrupt chunk 0:1"):
        Archive.read(spark, out).run().collect()


def test_lost_manifest_and_volume(spark, tmp_path):
    import shutil

    out = str(tmp_path / "x")
    Archive.write(spark, files(spark)).output(out).chunk_size(300).block_size(2000).volume_size(900).run()
    shutil.rmtree(f"{out}/manifest")
    r = A.Reader(spark, out)
    assert {x.status for x in r.read().collect()} == {"ok"}
    volumes = [d for d in os.listdir(f"{inside(out)}/chunks") if d.startswith("volume_id=")]
    assert len(volumes) > 2
    assert {x.healthy for x in r.volumes().collect()} == {True}
    shutil.rmtree(f"{inside(out)}/chunks/volume_id=2")
    assert {x.volume_id for x in r.volumes().filter("not healthy").collect()} == {2}
    lost = {x.block_id for x in r.missing().collect()}
    got = r.read().filter("entry_type = 'file'").collect()
    assert lost and {x.status for x in got} == {"ok", "missing_volume"}
    assert all((x.status == "missing_volume") == (x.block_id in lost and x.size > 0) for x in got)


def test_a_lost_job_leaves_the_old_archive(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "x")
    Archive.write(spark, files(spark, 10)).output(out).chunk_size(500).volume_size(2000).run()
    want = sorted((r.path, bytes(r.content)) for r in Archive.read(spark, out).run().collect())

    def lost(*a, **k):
        raise OSError("the job is lost")

    for what, name in ((A.grouping, "volumes"), (A.integrity, "table_digest"), (A.codec, "stream_diagnostics"), (A.store, "delete")):
        with monkeypatch.context() as m:
            m.setattr(what, name, lost)
            with pytest.raises(OSError):
                Archive.write(spark, files(spark, 12)).output(out).chunk_size(500).volume_size(2000).analysis().overwrite().run()
        if name != "delete":  # the old archive is there until the new manifest is
            assert sorted((r.path, bytes(r.content)) for r in Archive.read(spark, out).run().collect()) == want
    assert Archive.read(spark, out).run().count() == 12
    Archive.write(spark, files(spark, 5)).output(out).overwrite().run()
    assert Archive.read(spark, out).run().count() == 5 and sorted(os.listdir(out))[-2:] == ["manifest", "manifest_copy"] and len(os.listdir(out)) == 3
    assert {r.status for r in Archive.read(spark, out).verify().collect()} == {"ok"}
    assert not os.path.exists(f"{inside(out)}/volume_index")


def test_extraction_tells_what_failed(spark, tmp_path):
    import shutil

    out = str(tmp_path / "x")
    Archive.write(spark, files(spark)).output(out).chunk_size(300).block_size(2000).volume_size(900).run()
    shutil.rmtree(f"{inside(out)}/chunks/volume_id=2")
    index = f"{inside(out)}/file_index"
    rows = spark.read.parquet(index)
    wrong = rows.withColumn("sha256", F.when(F.col("path") == "d1/f1", F.lit("0" * 64)).otherwise(F.col("sha256"))).collect()
    shutil.rmtree(index)
    spark.createDataFrame(wrong, rows.schema).write.parquet(index)
    got = {r.path: r.status for r in Archive.read(spark, out).output(str(tmp_path / "back")).run().collect()}
    assert len(got) == 40 and set(got.values()) >= {"ok", "missing_volume"} and got["d1/f1"] not in (None, "ok")
    assert {p for p in got if (tmp_path / "back" / p).exists()} == {p for p, s in got.items() if s == "ok"}


def test_the_key_is_in_no_plan(spark):
    from loomstone.operators import crypto

    key = bytes(range(65, 97))
    df = spark.createDataFrame([(1, bytearray(b"some text"))], "id long, v binary")
    sealed = crypto.encrypt(df, "v", key, "00" * 16, ["id"])
    for x in (sealed, crypto.decrypt(sealed, "v", key, ["id"]), crypto.try_decrypt(sealed, "v", key, ["id"])):
        plan = x._jdf.queryExecution().toString()
        assert "AES" in plan.upper() and key.decode() not in plan and key.hex().upper() not in plan.upper() and "65, 66, 67" not in plan
    assert bytes(crypto.decrypt(sealed, "v", key, ["id"]).first().v) == b"some text"


def test_session_settings(spark, tmp_path):
    wave = tree.buffer_as_file(spark, np.sin(np.arange(20_000) / 50).astype("<f4").tobytes(), "wave.dat")
    spark.conf.set("spark.loomstone.transpose", "false")
    spark.conf.set("spark.loomstone.level", "fast")
    spark.conf.set("spark.loomstone.analysis", "true")
    try:
        Archive.write(spark, wave).output(str(tmp_path / "x")).run()
        Archive.write(spark, wave).output(str(tmp_path / "y")).transpose(True).run()
    finally:
        for name in ("transpose", "level", "analysis"):
            spark.conf.unset(f"spark.loomstone.{name}")
    plain, split = (A.Reader(spark, str(tmp_path / n)) for n in "xy")
    assert plain.manifest.level == "fast" and plain.manifest.compressed_size > split.manifest.compressed_size
    streams = {r.stream: r for r in Archive.read(spark, str(tmp_path / "x")).analysis().collect()}
    assert set(streams) == {"flags", "literals", "lengths", "slots", "reps"}
    r = streams["literals"]
    assert 0 < r.mean_h1 <= r.mean_h0 <= 8 and 0.5 < r.efficiency <= 1.01 and r.savings < 1


def test_command_line(spark, tmp_path, capsys):
    from loomstone.__main__ import main

    root, out = make_tree(tmp_path / "in"), str(tmp_path / "x")
    assert main(["compress", str(root), out, "--verify", "--timings"]) == 0
    told = capsys.readouterr().out
    assert "5 files" in told and "verify: " in told
    with pytest.raises(A.ArchiveExists):
        main(["compress", str(root), out])
    assert main(["compress", str(root), out, "--force", "--level", "fast"]) == 0
    assert f"replacing {out}/manifest" in capsys.readouterr().out
    assert main(["list", out]) == 0 and capsys.readouterr().out.split() == ["a.txt", "ramp.bin", "sub/deep/zero", "sub/noise", "sub/wave.dat"]
    assert main(["verify", out]) == 0 and capsys.readouterr().out.split() == ["ok", "5"]
    assert main(["extract", out, str(tmp_path / "back")]) == 0 and "ok" in capsys.readouterr().out
    assert contents(tmp_path / "back") == contents(root)


def test_unsafe_paths(spark, tmp_path):
    for bad in ("../x", "/abs", "a/../../x", "a//b", "", "a\\..\\b", "."):
        assert not tree.safe_path(bad)
        df = spark.createDataFrame([(bad,)], "p string")
        assert df.filter(tree.is_safe(F.col("p"))).count() == 0
        with pytest.raises(ValueError):
            Archive.write(spark, tree.table_as_files(df, F.col("p"), F.lit("x"))).output(str(tmp_path / "y")).run()
    assert tree.safe_path("a/b.c") and spark.createDataFrame([("a/..b/c..",)], "p string").filter(tree.is_safe(F.col("p"))).count() == 1
    twice = spark.createDataFrame([("a",), ("a",)], "p string")
    with pytest.raises(ValueError):
        Archive.write(spark, tree.table_as_files(twice, F.col("p"), F.lit("x"))).output(str(tmp_path / "y")).run()


def test_writing_never_follows_links(spark, tmp_path):
    os.makedirs(tmp_path / "out")
    os.makedirs(tmp_path / "elsewhere")
    os.symlink(tmp_path / "elsewhere", tmp_path / "out/dir")
    rows = [("dir/f", "file", bytearray(b"x"), None), ("../up", "file", bytearray(b"x"), None), ("l", "symlink", None, "/etc"), ("m", "symlink", None, "../.."), ("ok", "file", bytearray(b"y"), None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "path string, entry_type string, content binary, target string, permissions long, mtime timestamp")
    got = {r.path: r.status for r in tree.write_tree(df, str(tmp_path / "out")).collect()}
    assert got == {"dir/f": "unsafe", "../up": "unsafe", "l": "unsafe", "m": "unsafe", "ok": "ok"}
    assert os.listdir(tmp_path / "elsewhere") == []
    assert {r.status for r in tree.write_tree(df.filter("path = 'ok'"), str(tmp_path / "out")).collect()} == {"exists"}


def test_empty(spark, tmp_path):
    none = files(spark).limit(0)
    out = str(tmp_path / "x")
    Archive.write(spark, none).output(out).verify().run()
    assert Archive.read(spark, out).run().count() == 0


def test_shared_folder():
    """Without a shared folder only a session on one machine goes on."""
    from types import SimpleNamespace

    from loomstone.sources.store import shared_dir

    def session(master, folder=None, checkpoint=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder), sparkContext=context)

    assert shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x"
    assert shared_dir(session("spark://host:7077", None, "s3a://y")) == "s3a://y"
    assert shared_dir(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
