"""Follow the record stride of byte streams, and code deltas across fragments.

Detector: strides 1 to 16 are tested on a sample once enough bytes have passed; one is confirmed after
three tests in a row with r >= 0.75. Every 1,024 bytes are checked against the confirmed stride: r >= 0.60 is
fine, eight in a row are a stable stretch, which makes tests rarer; less is a drift, which makes them frequent again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.numeric import STREAM_THRESHOLD, autocorrelation, autocorrelations
from loomstone.functions.transforms import delta, undelta
from loomstone.sources.store import shared_dir

WINDOW, INTERVAL, CONFIRMATIONS, DRIFT, STABLE = 1024, 64 << 10, 3, 0.15, 8
# By mode the bytes between tests in intervals, and the size of a sample.
MODES = {"hot": (1, 4096), "warm": (4, 2048), "cold": (16, 1024)}
COOLER = {"hot": "warm", "warm": "cold", "cold": "cold"}
HISTORY = "stream_id string, pos long, stride int, mode string, drifted boolean"


class Detector:
    """The state of one stream; ``feed`` gives (pos, stride, mode, drifted) of each whole window."""

    def __init__(self, state: str | None = None) -> None:
        s = json.loads(state) if state else {}
        self.mode = s.get("mode", "hot")
        self.since = s.get("since", INTERVAL)  # the first test comes with the first sample
        self.streaks = s.get("streaks", [0] * 16)
        self.stride = s.get("stride", 0)
        self.stable = s.get("stable", 0)
        self.pos = s.get("pos", 0)
        self.rest = bytes.fromhex(s.get("rest", ""))

    def dump(self) -> str:
        kept = {n: getattr(self, n) for n in ("mode", "since", "streaks", "stride", "stable", "pos")}
        return json.dumps(kept | {"rest": self.rest.hex()})

    def _test(self, sample: bytes) -> None:
        best = (0.0, 0)
        for i, r in enumerate(autocorrelations(sample, range(1, 17))):
            self.streaks[i] = self.streaks[i] + 1 if r >= STREAM_THRESHOLD else 0
            if self.streaks[i] >= CONFIRMATIONS and r > best[0]:
                best = (r, i + 1)
        self.stride = best[1]
        self.since = 0

    def feed(self, data: bytes, last: bool = False) -> list[tuple[int, int, str, bool]]:
        self.rest += data
        out = []
        while len(self.rest) >= WINDOW:
            every, size = MODES[self.mode]
            if self.since >= every * INTERVAL:
                if len(self.rest) < size and not last:
                    break  # until a whole sample is there
                self._test(self.rest[:size])
            window, self.rest = self.rest[:WINDOW], self.rest[WINDOW:]
            drifted = False
            if self.stride:
                if autocorrelation(window, self.stride) >= STREAM_THRESHOLD - DRIFT:
                    self.stable += 1
                    if self.stable >= STABLE:
                        self.mode = COOLER[self.mode]
                else:
                    drifted, self.stride, self.stable, self.mode = True, 0, 0, "hot"
            out.append((self.pos, self.stride, self.mode, drifted))
            self.pos += WINDOW
            self.since += WINDOW
        return out


def _follow(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    detector = Detector(state.get[0] if state.exists else None)
    rows = pd.concat(list(frames)).sort_values("offset")
    found = [x for d in rows["data"] for x in detector.feed(bytes(d))]
    state.update((detector.dump(),))
    yield pd.DataFrame([(key[0], *x) for x in found], columns=["stream_id", "pos", "stride", "mode", "drifted"])


def stride_history(fragments: DataFrame) -> DataFrame:
    """A stream of fragments to a stream of windows (stream_id, pos, stride, mode, drifted).

    Fragments of a stream must arrive in the order of their offsets from one trigger to the next."""
    return fragments.groupBy("stream_id").applyInPandasWithState(_follow, HISTORY, "state string", "append", "NoTimeout")


def stride_history_batch(fragments: DataFrame) -> DataFrame:
    """The same windows of a finished table of fragments, read in the order of their offsets, a batch at a time. Fragments
    with one offset come in the order of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "pos", "stride", "mode", "drifted"]
        key, detector, found = None, Detector(), []

        def out() -> pa.RecordBatch:
            cols = [list(x) for x in zip(*found, strict=True)] if found else [[] for _ in names]
            found.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for stream, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if stream != key:
                    found += [(key, *x) for x in detector.feed(b"", last=True)]
                    key, detector = stream, Detector()
                found += [(key, *x) for x in detector.feed(data)]
            yield out()
        found += [(key, *x) for x in detector.feed(b"", last=True)]
        yield out()

    n = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = fragments.select("stream_id", "offset", "data").repartition(n, "stream_id").sortWithinPartitions("stream_id", "offset", "data")
    return ordered.mapInArrow(run, HISTORY)


CODED = "stream_id string, offset long, place long, data binary"


def _carried(stride: int, back: bool):
    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, place = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
        rows = pd.concat(list(frames)).sort_values(["place"] if back else ["offset", "data"])
        out = []
        for at, (offset, data) in enumerate(zip(rows["offset"], rows["data"], strict=True), place):
            if back and rows["place"].iat[at - place] != at:
                raise ValueError("a fragment is missing or came too late")
            done, held = (undelta if back else delta)(bytes(data), stride, held)
            out.append((key[0], offset, at, done))
        state.update((held, place + len(out)))
        yield pd.DataFrame(out, columns=["stream_id", "offset", "place", "data"])

    return run


def stream_delta(fragments: DataFrame, stride: int, back: bool = False) -> DataFrame:
    """Deltas (or with ``back`` the bytes again) of a stream of fragments; the last bytes carry over.

    Fragments are taken in the order of their offsets in a trigger, those with one offset in the order of their bytes, and
    from trigger to trigger as they arrive. ``place`` numbers them as they were taken, and the way back goes by it: so it gives
    the same bytes in whatever order they arrived."""
    return fragments.groupBy("stream_id").applyInPandasWithState(_carried(stride, back), CODED, "held binary, place long", "append", "NoTimeout")


def fragments_of(spark: SparkSession, folder: str, name: str, key: str, value: str, schema: str, stream: bool, offset: str | None = None) -> DataFrame:
    """A table in a folder, one file or a folder of files, as fragments: one stream for each key, its fragments in the order of
    a column; without one a row is a stream of its own, at offset 0. Null values are no fragments."""
    if stream:
        # a pattern, as a stream's plain path must be a folder
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}.parque[t]")
    else:
        df = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    place = (F.lit(0) if offset is None else F.col(offset)).cast("long").alias("offset")
    out = df.select(F.col(key).cast("string").alias("stream_id"), place, F.col(value).cast("binary").alias("data"))
    return out.filter("data IS NOT NULL")


def run_to_folder(stream: DataFrame, spark: SparkSession) -> str:
    """Run a stream over all that is there, into Parquet files in the shared folder; where they are, also if there are none."""
    import uuid

    at = f"{shared_dir(spark).rstrip('/')}/loomstone/{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(at)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return f"{at}/out"


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all that is there, into a Parquet table in the shared folder."""
    return spark.read.schema(stream.schema).parquet(run_to_folder(stream, spark))
