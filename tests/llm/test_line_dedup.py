from collections import Counter

import numpy as np
import pytest

from loomstone.llm import bloom
from loomstone.llm.line_dedup import MOST_BITS, dedup_lines, line_keys
from tests.llm.helpers import EDGE, clashing, docs


def brute(rows, min_docs, first=False):
    keys = [[k for k in line_keys((t or "").encode())] for _, t, *_ in rows]
    counts = Counter(k for ks in keys for k in set(ks) if k)
    first_id = {}
    for (i, *_), ks in zip(rows, keys, strict=True):
        for k in ks:
            if i is not None and (k not in first_id or i < first_id[k]):
                first_id[k] = i
    out = []
    for (i, t, *_), ks in zip(rows, keys, strict=True):
        kept, used = [], set()
        for line, k in zip((t or "").split("\n"), ks, strict=True):
            if k and counts[k] >= min_docs:
                if not (first and first_id.get(k) == i and k not in used):
                    continue
                used.add(k)
            kept.append(line)
        out.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, bits=1 << 16, **kw).collect()), key=str)


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_edge_rows(spark, min_docs):
    assert run(docs(spark), min_docs=min_docs) == brute(EDGE, min_docs)


def test_keep_first(spark):
    rows = [(i, "  Shared LINE\t\nown %d\nshared line\n\nlast" % i, "en", "s", 1) for i in range(12)]
    got = run(docs(spark, rows), min_docs=5, keep="first")
    assert got == brute(rows, 5, True)
    assert [r for r in got if r[0] == 0][0][3] == "  Shared LINE\t\nown 0\n\nlast"


def test_full_filters_are_still_exact(spark):
    rows = [(i, "\n".join(f"line {i % 7} {j}" for j in range(30)) + f"\nonly {i}", "en", "s", 1) for i in range(60)]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(spark, rows), bits=512, min_docs=9).collect()), key=str)
    assert got == brute(rows, 9)


def test_clashing_columns_and_empty_table(spark):
    got = dedup_lines(clashing(docs(spark)), min_docs=3, bits=1 << 16)
    assert got.count() == len(EDGE)
    assert dict(got.dtypes)["n_lines"] == "bigint"
    assert dedup_lines(docs(spark, []), bits=1 << 16).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
def test_many_keys_are_joined(spark, keep):
    """The same result where the keys to drop are too many to travel."""
    rows = [*EDGE, *((100 + i, f"Shared {i % 3}\nshared {i % 4}\n\nown {i}\nSHARED {i % 3} ", "en", "s", 1) for i in range(50))]
    want = brute(rows, 3, keep == "first")
    assert run(docs(spark, rows), min_docs=3, keep=keep, most_keys=0) == want
    assert run(docs(spark, rows), min_docs=3, keep=keep) == want


def test_few_false_alarms():
    """At the size that is chosen for a million keys, twice as many keys as are repeated are never suspects; at most a few in a thousand are."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 1_000_000, np.uint64)
    bits = bloom.size_for(len(keys) + 50_000, MOST_BITS)
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    repeats = 0
    for part in np.array_split(np.r_[keys, keys[:50_000]], 64):
        seen = bloom.has(once, part)
        repeats += int(seen.sum())
        bloom.put(twice, part[seen])
        bloom.put(once, part)
    assert bloom.has(twice, keys[:50_000]).all()
    assert bloom.has(twice, keys).sum() < 1.1 * 50_000
    assert bloom.size_for(10**8, MOST_BITS) >= 16 * 10**8


def test_size_follows_the_lines(spark):
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(200)) + "\nshared", "en", "s", 1) for i in range(30)]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(spark, rows), min_docs=9).collect()), key=str)
    assert got == brute(rows, 9)


def test_other_keep(spark):
    with pytest.raises(ValueError):
        dedup_lines(docs(spark), keep="some")
