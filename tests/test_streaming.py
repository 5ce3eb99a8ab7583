import os

import numpy as np

from loomstone.functions.transforms import delta
from loomstone.streaming.strides import Detector, fragments_of, run_to_table, stream_delta, stride_history, stride_history_batch


def wave(n, stride=4):
    return np.repeat(np.arange(n // stride + 1), stride)[:n].astype(np.uint8).tobytes() if stride == 1 else (np.tile([0, 80, 160, 240], n // 4 + 1)[:n] + RNG.integers(0, 3, n)).astype(np.uint8).tobytes()


RNG = np.random.default_rng(42)


def test_detector_confirms_cools_and_drifts():
    noise = RNG.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    d = Detector()
    rows = d.feed(wave(1_000_000)) + d.feed(noise) + d.feed(b"", last=True)
    confirmed = [r for r in rows if r[1] == 4]
    assert confirmed[0][0] == 2 * 65536  # the third test in a row
    assert {r[2] for r in rows} == {"hot", "warm", "cold"}
    drift = next(r for r in rows if r[3])
    assert drift[0] == 1_000_000 // 1024 * 1024 or abs(drift[0] - 1_000_000) <= 2048
    assert drift[1] == 0 and drift[2] == "hot"
    assert [r[0] for r in rows] == [1024 * i for i in range(len(rows))]


def test_state_survives():
    data = wave(400_000)
    whole = Detector().feed(data)
    parts, state = [], None
    for at in range(0, len(data), 7777):
        d = Detector(state)
        parts += d.feed(data[at : at + 7777])
        state = d.dump()
    assert parts == whole[: len(parts)] and len(whole) - len(parts) <= 4


def write(spark, folder, rows):
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(rows, "stream_id string, offset long, data binary").coalesce(1).write.mode("append").parquet(str(folder))


def test_streams(spark, tmp_path):
    data = {"a": wave(300_000), "b": RNG.integers(0, 256, 100_000, dtype=np.uint8).tobytes()}
    rows = [(k, at, bytearray(v[at : at + 50_000])) for k, v in data.items() for at in range(0, len(v), 50_000)]
    write(spark, tmp_path / "in", rows)
    schema = "stream_id string, offset long, data binary"
    live = run_to_table(stride_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), spark)
    got = sorted(map(tuple, live.collect()))
    whole = sorted(map(tuple, stride_history_batch(spark.read.schema(schema).parquet(str(tmp_path / "in"))).collect()))
    assert got and set(got) <= set(whole) and len(whole) - len(got) <= 8
    coded = run_to_table(stream_delta(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4), spark).collect()
    for k, v in data.items():
        assert b"".join(bytes(r.data) for r in sorted(coded, key=lambda r: r.offset) if r.stream_id == k) == delta(v, 4)[0]


def test_table_as_fragments(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert fragments_of(spark, str(tmp_path), "t", "k", "v", "k long, v string", stream=False).count() == 1


def test_the_history_query_confirms_cools_and_drifts(spark):
    import pytest

    from loomstone.plans.engine import CATALOGUE

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    rows = CATALOGUE.queries["stream_stride_history"](spark, sf).collect()
    assert {r.stride for r in rows} == {0, 16} and {r.mode for r in rows} >= {"hot", "warm"}
    for stream in {r.stream_id for r in rows}:
        mine = sorted((r.pos, r.stride, r.drifted) for r in rows if r.stream_id == stream)
        assert [p for p, *_ in mine] == [1024 * i for i in range(len(mine))]
        assert sum(d for *_, d in mine) == 1 and mine[-1][1] == 0


def test_the_delta_query_reads_tables_of_several_files(spark, tmp_path):
    import hashlib

    from loomstone.plans.engine import CATALOGUE

    # turns out of their order from file to file, repeated turns, null and empty texts, one row more than once
    files = [[(1, 3, "u", "third"), (2, 1, "u", "")], [(1, 1, "u", "first one"), (1, 1, "u", "another first"), (2, 2, "u", None)], [(1, 2, "u", "second"), (1, 3, "u", "third")]]
    kind = "conv_id long, turn long, role string, text string"
    for name, parts in (("several", files), ("none", [[]])):
        for rows in parts:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "conversations.parquet"))
        got = CATALOGUE.queries["rt_stream_delta"](spark, str(tmp_path / name)).collect()
        want = [(str(c), t, None if x is None else hashlib.sha256(x.encode()).hexdigest()) for rows in parts for c, t, _, x in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
