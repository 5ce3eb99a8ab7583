import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import numeric
from loomstone.operators import codec, contexts, crypto, grouping, integrity, profile, sequence

RNG = np.random.default_rng(42)
VALUES = [(1, None), (2, b""), (3, b"x"), (4, b"text and text and text " * 40), (5, RNG.integers(0, 256, 3000, dtype=np.uint8).tobytes()), (6, (np.tile([0, 80, 160, 240], 4000) + RNG.integers(0, 3, 16000)).astype(np.uint8).tobytes()), (7, b"MZ" + b"\0" * 100), (7, b"twice"), (7, b"twice")]


@pytest.fixture
def values(spark):
    return spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in VALUES], "k long, v binary")


def test_profile(values):
    got = sorted(((r.k, r.n_bytes, r.entropy, r.stride) for r in profile.profile(values, "v").collect()), key=str)
    want = sorted(((k, len(v) if v is not None else None, numeric.entropy(v) if v is not None else None, numeric.file_stride(v) if v is not None else None) for k, v in VALUES), key=str)
    assert got == want
    kinds = {r.k: r.content_type for r in profile.classify(values, "v").collect()}
    assert kinds[4] == "text" and kinds[6] == "multimedia" and kinds[1] == "binary"
    assert profile.entropies(values, "v").count() == len(VALUES)
    assert profile.byte_histogram(values, "v").agg(F.sum("n")).first()[0] == sum(len(v or b"") for _, v in VALUES)
    assert profile.byte_histogram(values.limit(0), "v").count() == 0
    ctx = profile.context_histogram(values, "v", "lsb6").agg(F.sum("n"), F.max("context")).first()
    assert ctx[0] == sum(max(0, len(v or b"") - 1) for _, v in VALUES) and ctx[1] < 64


def test_sequences(spark):
    data = RNG.integers(0, 256, 103, dtype=np.uint8)
    rows = spark.createDataFrame([(k, i, int(b)) for k in (1, 2) for i, b in enumerate(data[: 103 if k == 1 else 3])], "k int, pos int, b int")
    from loomstone.functions import transforms

    for s in (1, 4):
        d = sequence.delta(rows, "k", "pos", "b", s)
        got = [r.d for r in d.filter("k = 1").orderBy("pos").collect()]
        assert bytes(got) == transforms.delta(data.tobytes(), s)[0]
        back = sequence.undelta(d.drop("b"), "k", "pos", "d", s)
        assert [r.v for r in back.filter("k = 1").orderBy("pos").collect()] == data.tolist()
    t = sequence.transpose(rows, "k", "pos", 4)
    assert bytes(r.b for r in t.filter("k = 1").orderBy("out_pos").collect()) == transforms.transpose(data.tobytes(), 4)
    assert [r.out_pos for r in t.filter("k = 2").orderBy("pos").collect()] == [0, 1, 2]
    b = sequence.byte_rows(spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "k int, v string"), "k", "v", 10)
    assert [tuple(r) for r in b.orderBy("k", "pos").collect()] == [(1, 0, 97), (1, 1, 98)]


def test_runs_with_nulls(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 4, 4, 0, None])], "k int, o int, v int")
    assert [(r.run, r.value, r.start, r.stop, r.n) for r in sequence.runs(rows, "k", "o", "v").orderBy("run").collect()] == [(1, None, 0, 1, 2), (2, 4, 2, 3, 2), (3, 0, 4, 4, 1), (4, None, 5, 5, 1)]


def test_first_fit_keeps_everything(spark):
    assert grouping.first_fit([5, 9, 4, 100, 1, 0], 10) == [0, 1, 0, 2, 0, 0]
    sizes = RNG.integers(0, 130, 3000).tolist()
    room, want = [], []
    for size in sizes:
        at = next((i for i, r in enumerate(room) if size <= r), len(room))
        if at == len(room):
            room.append(100)
        room[at] -= size
        want.append(at)
    assert grouping.first_fit(sizes, 100) == want
    files = [(f"d/f{i:03d}.{'ab'[i % 2]}", int(RNG.integers(0, 90)), "text" if i % 3 else "binary") for i in range(300)] + [("big", 1000, "text"), ("none", 0, "raw")]
    df = spark.createDataFrame(files, "path string, size long, block_type string")
    for rows in (1_000_000, 40):
        packed = grouping.block_ids(grouping.pack_blocks(df, 100, rows))
        totals = grouping.block_totals(packed, 100).collect()
        assert packed.count() == len(files)
        assert all(t.n_bytes <= 100 or t.n_files == 1 for t in totals)
        assert packed.groupBy("block_id").agg(F.countDistinct("block_type").alias("c")).filter("c > 1").count() == 0
    one = grouping.pack_blocks(df, 100).filter("block_type = 'text'").collect()
    order = sorted((f for f in files if f[2] == "text"), key=lambda f: ("." in f[0], f[0].rsplit(".", 1)[-1] if "." in f[0] else "", f[0]))
    want = dict(zip((f[0] for f in order), grouping.first_fit([f[1] for f in order], 100), strict=True))
    assert {r.path: r.block_no for r in one} == want
    full = grouping.block_offsets(grouping.block_ids(grouping.pack_blocks(df, 100)))
    for r in full.groupBy("block_id").agg(F.min("block_offset").alias("lo"), F.max(F.col("block_offset") + F.col("size")).alias("hi"), F.sum("size").alias("s")).collect():
        assert r.lo == 0 and r.hi == r.s


def test_ranks_over_ranges(spark):
    rows = [(k, int(v)) for k, n in (("a", 700), (None, 30), ("b", 1)) for v in RNG.permutation(n)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = grouping.ranked(df, "g", [F.col("v").asc()], "place").collect()
    assert len(got) == len(rows) and all(r.place == r.v + 1 for r in got)


def test_volumes(spark):
    blocks = spark.createDataFrame([(0, 40), (1, 40), (2, 500), (3, 10)], "block_id long, size long")
    got = [tuple(r) for r in grouping.volumes(blocks, 140).orderBy("block_id").select("volume_id", "volume_offset", "oversize").collect()]
    assert got == [(1, 50, False), (1, 90, False), (2, 50, True), (3, 50, False)]
    assert grouping.volumes(blocks.limit(0), 140).count() == 0
    healthy = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 3)], "archive_id string, volume_id int")
    assert {r.archive_id: r.volume_id for r in grouping.metadata_volume(healthy).collect()} == {"a": 1, "b": 3}


def test_chunks(spark, values):
    got = grouping.chunks_of(values, "v", 1000).groupBy("k").agg(F.sum(F.length("chunk")).alias("n"), F.count(F.lit(1)).alias("c")).collect()
    assert {r.k: (r.n, r.c) for r in got if r.k != 7} == {2: (0, 1), 3: (1, 1), 4: (920, 1), 5: (3000, 3), 6: (16000, 16)}


@pytest.mark.parametrize("level", ["tiny", "fast", "balanced", "maximum"])
def test_codec(spark, values, level):
    kinds = values.filter("k <> 7").withColumn("kind", F.when(F.col("k") == 4, "text").when(F.col("k") == 6, "multimedia").otherwise("binary"))
    coded = codec.encode(kinds, "v", level, "kind")
    rows = {r.k: r for r in coded.collect()}
    assert rows[5].codec == "lz77" or rows[5].codec == "raw"
    assert rows[2].codec == "raw" and rows[1].codec is None
    assert len(rows[4].payload) < 500 and rows[4].codec == "lz77"
    back = {r.k: r.value and bytes(r.value) for r in codec.decode(coded).collect()}
    assert back == {k: v or None if v is None else v for k, v in VALUES if k != 7} or {k: (v or b"") for k, v in back.items()} == {k: (v or b"") for k, v in VALUES if k != 7}
    assert codec.decode(codec.encode(values.limit(0), "v", level)).count() == 0


def test_mixed_raw_and_coded_chunks(spark):
    noise, text = RNG.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), b"abc " * 5000
    df = spark.createDataFrame([(0, bytearray(noise)), (1, bytearray(text)), (2, bytearray(noise))], "n int, v binary")
    coded = codec.encode(df, "v", "fast")
    assert [r.codec for r in coded.orderBy("n").collect()] == ["raw", "lz77", "raw"]
    assert [bytes(r.value) for r in codec.decode(coded).orderBy("n").collect()] == [noise, text, noise]


def test_float_data_gets_a_transform(spark):
    wave = (1000 + 10 * np.sin(np.arange(20_000) / 100)).astype("<f4").tobytes()
    df = spark.createDataFrame([(0, bytearray(wave), "multimedia")], "n int, v binary, kind string")
    r = codec.encode(df, "v", "fast", "kind").first()
    plain = codec.encode(df.withColumn("kind", F.lit("text")), "v", "fast", "kind").first()
    assert (r.transform.stride or r.transform.filter in ("float_channel_split", "word_delta")) and len(r.payload) < len(plain.payload)
    assert bytes(codec.decode(codec.encode(df, "v", "fast", "kind")).first().value) == wave


def test_records_are_found_by_entropy():
    a = np.arange(20_000) / 1000
    xyz = np.stack([a * np.cos(a), a * np.sin(a), 0.1 * a], 1).astype("<f4").tobytes()
    assert numeric.chunk_stride(xyz) is None and numeric.cheapest_stride(xyz) in (4, 12)
    ((kind, _, stack, payload),) = codec.encode_batch([xyz], ["binary"], "fast")
    assert kind == "lz77" and stack != codec.X.Stack() and len(payload) < len(xyz) / 3
    assert codec.decode_batch([kind], [len(xyz)], [stack], [payload]) == [xyz]
    for text in (b"plain words and more of them " * 50, RNG.integers(0, 256, 70_000, dtype=np.uint8).tobytes(), b"", b"ab"):
        assert numeric.cheapest_stride(text) in (None, *([] if b"plain" not in text else range(2, 17)))


def test_bwt_is_kept_only_if_smaller():
    text = "".join(f"a{i:03d}" for i in range(1000)).encode() * 2
    (chosen,) = codec.encode_batch([text], ["text"], "maximum")
    sizes = [len(codec.code_tokens([codec.K.parse_optimal(t, codec.K.LEVELS["maximum"])], [None])[0]) for t in (text, codec.X.bwt(text)[0])]
    assert chosen[2].bwt == (sizes[1] < sizes[0]) and len(chosen[3]) == min(sizes)


def test_bad_level(values):
    with pytest.raises(ValueError):
        codec.encode(values, "v", "enormous")


def test_contexts(spark, values):
    some = values.filter("v IS NOT NULL")
    want = sorted((v for _, v in VALUES if v is not None))
    assert sorted(bytes(r.value) for r in contexts.decode(contexts.encode(some, "v")).collect()) == want
    small = some.filter("length(v) < 1000")
    assert sorted(bytes(r.value) for r in contexts.ppm_decode(contexts.ppm_encode(small, "v")).collect()) == [v for v in want if len(v) < 1000]
    assert contexts.decide(values, "v").count() == len(VALUES)


def test_verify(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    stored = integrity.checksums(df, "v").select("k", "crc32", "sha256").filter("k <> 3").union(spark.createDataFrame([(9, 1, "x")], "k int, crc32 long, sha256 string"))
    changed = df.withColumn("v", F.when(F.col("k") == 2, "B").otherwise(F.col("v")))
    assert {r.k: r.status for r in integrity.verify(changed, "k", "v", stored).collect()} == {1: "ok", 2: "crc_mismatch", 3: "not_found", 9: "missing"}
    assert spark.createDataFrame([("123456789",)], "v string").select(F.crc32("v")).first()[0] == 3421780262
    assert spark.createDataFrame([("hello world",)], "v string").select(F.crc32("v")).first()[0] == 0x0D4A1185


def test_encryption(spark):
    kdf = crypto.Kdf("00" * 16, n=1 << 10)
    key, other = kdf.key("right"), kdf.key("wrong")
    df = spark.createDataFrame([(0, bytearray(b"one")), (1, bytearray(b"")), (2, bytearray(b"one"))], "n long, v binary")
    sealed = crypto.encrypt(df, "v", key, kdf.salt, ["n"])
    rows = [bytes(r.v) for r in sealed.orderBy("n").collect()]
    assert len(set(rows)) == 3 and all(len(r) == 28 + len(p) for r, p in zip(rows, (b"one", b"", b"one"), strict=True))
    assert [bytes(r.v) for r in crypto.encrypt(df, "v", key, kdf.salt, ["n"]).orderBy("n").collect()] == rows  # a task that is run again
    assert [bytes(r.v) for r in crypto.decrypt(sealed, "v", key, ["n"]).orderBy("n").collect()] == [b"one", b"", b"one"]
    assert {r.v for r in crypto.try_decrypt(sealed, "v", other, ["n"]).collect()} == {None}
    moved = sealed.withColumn("n", 2 - F.col("n"))
    assert {r.n for r in crypto.try_decrypt(moved, "v", key, ["n"]).filter("v IS NOT NULL").collect()} == {1}
    mark = crypto.sentinel(spark, key, kdf.salt)
    assert crypto.check_sentinel(spark, mark, key) and not crypto.check_sentinel(spark, mark, other)
    with pytest.raises(ValueError):
        crypto.check_sentinel(spark, mark[:-1], key)
    assert spark.range(1).select(F.hex(crypto.little_endian(F.lit(258)))).first()[0] == "0201000000000000"


def test_lagged_correlation_in_runs(spark):
    """A key with most of the rows, cut into runs: the same as over the whole sequence."""
    import numpy as np

    from loomstone.operators import profile

    rng = np.random.default_rng(5)
    rows = [("hot" if i % 9 else "cold", i, float(rng.normal() + np.sin(i / 3))) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    got = {(r.k, r.lag): r.r for r in profile.lagged_correlation(df, "v", "i", [1, 3, 7], ["k"], run_rows=20).collect()}
    for k in ("hot", "cold"):
        v = np.array([x for key, _, x in rows if key == k])
        for lag in (1, 3, 7):
            assert abs(got[k, lag] - np.corrcoef(v[lag:], v[:-lag])[0, 1]) < 1e-9


def test_blocks_by_ranges(spark):
    """Several ranges: every file once, no block over its capacity, and no block of two types or ranges."""
    rows = [(f"d/f{i:03d}.{'abc'[i % 3]}", 100 + 37 * i % 900, "text" if i % 4 else "binary") for i in range(300)]
    df = spark.createDataFrame(rows, "path string, size long, block_type string")
    for range_rows, shards in ((1000, 1), (60, 5)):
        got = grouping.pack_blocks(df, 2000, range_rows).collect()
        assert sorted(r.path for r in got) == sorted(r[0] for r in rows)
        assert 1 <= len({r.shard for r in got}) <= shards and (shards == 1 or len({r.shard for r in got}) > 2)
        blocks = {}
        for r in got:
            blocks.setdefault((r.block_type, r.shard, r.block_no), []).append(r.size)
        assert max(map(sum, blocks.values())) <= 2000


def test_best_stride_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from loomstone.plans.engine import CATALOGUE

    rng = np.random.default_rng(5)
    rows = [(s, o, n, float(q)) for s in range(400) for o, q in enumerate(rng.integers(1, 51, 40).tolist()) for n in (1, 2)]
    rows += [(1000, o, 1, -100.0) for o in range(40)]  # all bytes zero: no correlation
    rows += [(1001, o, 1, 7.0) for o in range(5)]  # short: fewer strides
    rows += [(None, o, 1, float(q)) for o, q in enumerate(rng.integers(1, 51, 40).tolist())]
    kind = "l_suppkey long, l_orderkey long, l_linenumber long, l_quantity double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, CATALOGUE.queries["best_stride"](spark, str(tmp_path)).collect()))
    assert len(got) > 400 and got == sorted(duckdb.sql(CATALOGUE.sql["best_stride"]).fetchall())


def test_best_stride_weighs_places_and_strides(spark):
    rows = [("a", 4, 0.9), ("a", 16, 0.90001), ("b", 4, 0.9), ("b", 8, 0.90001), ("c", 4, 0.499999), ("d", 4, 0.7), ("d", 8, 0.7000049)]
    got = profile.best_stride(spark.createDataFrame(rows, "k string, stride int, r double"), ["k"], 0.5).collect()
    assert sorted(map(tuple, got)) == [("a", 4, 0.90001), ("b", 8, 0.90001), ("d", 4, 0.7)]
