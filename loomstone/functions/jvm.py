"""The byte loops of ``Kernels.java`` in a helper process beside a Python worker, as Python needs microseconds a byte for them.

Java and Janino, which compiles the source, are wherever Spark is. A helper ends with the process that started it. Where none can
be started, or it ends early, or a value is over ``MOST``, calls give None and the Python beside them does the same."""

from __future__ import annotations

import atexit
import contextlib
import os
import pkgutil
import shutil
import subprocess
import sys
import tempfile
import threading
import warnings
from pathlib import Path
from types import SimpleNamespace

import numpy as np

#: It travels with the functions, as executors need not have this package.
SOURCE = pkgutil.get_data(__package__, "Kernels.java")
#: Bytes of a value that a helper takes: it needs some 100 for each. Megabytes of its heap, which grows as needed.
MOST, HEAP_MB = 1 << 20, 224


def _held() -> SimpleNamespace:
    """This process's helper. It is kept in sys: functions that travel by value have globals of their own in each task."""
    return sys.__dict__.setdefault(f"_loomstone_helper_{os.getpid()}", SimpleNamespace(lock=threading.RLock(), process=None, broken=False))


def _command() -> list[str]:
    """Raises FileNotFoundError without Java or Janino."""
    import pyspark

    home = os.environ.get("JAVA_HOME")
    java = shutil.which("java", path=f"{home}/bin") if home else None
    java = java or shutil.which("java")
    homes = [h for h in (os.environ.get("SPARK_HOME"), Path(pyspark.__file__).parent) if h]
    found = ([str(p) for name in ("janino", "commons-compiler") for p in Path(h, "jars").glob(f"{name}-[0-9]*.jar")] for h in homes)
    jars = next((f for f in found if len(f) > 1), None)
    if not java or not jars:
        raise FileNotFoundError("no Java with Janino")
    options = ["-XX:+UseSerialGC", "-XX:-UsePerfData", "-Xshare:auto", "-Xms16m", f"-Xmx{HEAP_MB}m"]
    return [java, *options, "-cp", os.pathsep.join(jars), "org.codehaus.janino.SimpleCompiler"]


def _start(held: SimpleNamespace) -> None:
    pipe = subprocess.PIPE
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, "Kernels.java")
        source.write_bytes(SOURCE)
        held.process = subprocess.Popen([*_command(), str(source), "Kernels"], stdin=pipe, stdout=pipe, stderr=subprocess.DEVNULL)
        atexit.register(_end, held.process, os.getpid())
        _read(held, 1)  # it is compiled


def _end(process: subprocess.Popen, owner: int) -> None:
    if owner == os.getpid():  # not a fork of the owner
        process.kill()
        process.wait()
        with contextlib.suppress(OSError):  # what it did not take
            process.stdin.close()


def _give_up(held: SimpleNamespace, why: Exception) -> None:
    held.broken = True
    warnings.warn(f"no helper for byte loops, they go in Python: {why}", stacklevel=2)
    if held.process is not None:
        _end(held.process, os.getpid())


def _read(held: SimpleNamespace, n: int) -> bytes:
    got = held.process.stdout.read(n)
    if len(got) < n:
        raise EOFError("the helper has ended")
    return got


def ready() -> bool:
    """Whether a helper runs, or can be started."""
    held = _held()
    with held.lock:
        if held.process is None and not held.broken:
            try:
                _start(held)
            except (OSError, EOFError) as e:
                _give_up(held, e)
    return not held.broken


def _ask(what: bytes, head: bytes, values: list[bytes], rest: list[bytes]) -> list[bytes] | None:
    """The answers for values, each with what else belongs to it; so many at a time that the helper's heap holds them."""
    held = _held()
    out: list[bytes] = []
    begin = 0
    with held.lock:
        if not ready():
            return None
        try:
            while begin < len(values):
                end, size = begin, 0
                while end < len(values) and (end == begin or size + len(values[end]) + len(rest[end]) <= MOST):
                    size += len(values[end]) + len(rest[end])
                    end += 1
                parts = [x for v, r in zip(values[begin:end], rest[begin:end], strict=True) for x in (len(v).to_bytes(4, "big"), v, r)]
                held.process.stdin.write(b"".join([what, (end - begin).to_bytes(4, "big"), head, *parts]))
                held.process.stdin.flush()
                out += [_read(held, int.from_bytes(_read(held, 4), "big")) for _ in range(begin, end)]
                begin = end
        except (OSError, EOFError) as e:
            _give_up(held, e)
            return None
        except BaseException:  # what is left of its answers must not meet the next call
            _end(held.process, os.getpid())
            held.process = None
            raise
    return out


def parse_optimal(values: list[bytes], leasts: list[np.ndarray | None], settings: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """Kinds, values and lengths of the tokens of each value. settings: window, good, threshold, 256 fractions of log2, extra bits by slot."""
    got = _ask(b"P", np.array(settings, ">i8").tobytes(), values, [b"\0" if m is None else b"\1" + m.astype(np.uint8).tobytes() for m in leasts])
    if got is None:
        return None
    out = []
    for rows in got:
        n = len(rows) // 7
        out.append((np.frombuffer(rows, np.uint8, n), np.frombuffer(rows, ">i4", n, n).astype(np.int64), np.frombuffer(rows, ">i2", n, 5 * n).astype(np.int64)))
    return out


def expand(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: list[int]) -> list[bytes] | None:
    """The bytes of tokens as parse_optimal gives them; none for tokens that do not stand for so many. Values are below 2^31, lengths below 2^15."""
    rows = [kind.astype(np.uint8).tobytes() + value.astype(">i4").tobytes() + length.astype(">i2").tobytes() for kind, value, length in parts]
    return _ask(b"X", b"", rows, [n.to_bytes(4, "big") for n in sizes])


def rans_encode(streams: list[bytes], tables: list[np.ndarray]) -> list[bytes] | None:
    """rans.encode_many of streams that are not empty; no bytes for one with a symbol without frequency."""
    return _ask(b"E", b"", streams, [t.astype(">u2").tobytes() for t in tables])


def rans_decode(coded: list[bytes], tables: list[np.ndarray], sizes: list[int]) -> list[bytes] | None:
    """rans.decode_many of streams of at least 8 bytes."""
    return _ask(b"D", b"", coded, [t.astype(">u2").tobytes() + n.to_bytes(4, "big") for t, n in zip(tables, sizes, strict=True)])


def bwt(x: bytes) -> tuple[bytes, int] | None:
    """The last column and the row of transforms.bwt for one chunk."""
    if len(x) > MOST or (got := _ask(b"B", b"", [x], [b""])) is None:
        return None
    return got[0][4:], int.from_bytes(got[0][:4], "big")


def unbwt(x: bytes, row: int) -> bytes | None:
    """transforms.unbwt of one chunk; the row is one of its rows."""
    if len(x) > MOST or (got := _ask(b"U", b"", [x], [row.to_bytes(4, "big")])) is None:
        return None
    return got[0]
