from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm.lz_fingerprint import Parse, as_text, edits_and_neighbours, fingerprint, likeness, likeness_of
from tests.llm.helpers import EDGE, clashing, docs, sha


def phrases(data):
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        sigs = [Parse().feed(x.encode()).signature() for x in (t, edited, nxt)]
        out.append((str(i), len(t), sha(edited), as_text(sigs[0]), as_text(sigs[1]), likeness(sigs[0], sigs[1]), likeness(sigs[0], sigs[2])))
    return sorted(out)


def run(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in edits_and_neighbours(df).collect())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 300))
def test_parse_in_parts(data, cut):
    from xxhash import xxh32_intdigest

    p = Parse().feed(data[:cut])
    q = p.copy().feed(data[cut:])
    assert set(q.hashes) == {xxh32_intdigest(x) for x in phrases(data)}
    assert as_text(p.feed(data[cut:]).signature()) == as_text(q.signature())


def test_edge_rows(spark):
    assert run(docs(spark)) == brute(EDGE)
    assert run(clashing(docs(spark))) == brute(EDGE)


def test_many_runs(spark):
    rows = [(i * 3 % 1009, f"text {i} " * (i % 50), "en", "s", 1) for i in range(1009)]
    assert run(docs(spark, rows)) == brute(rows)
    far = [((-1) ** i * 2**62 + i, f"number {i}", "en", "s", 1) for i in range(600)]
    assert run(docs(spark, far)) == brute(far)


def test_single_and_none(spark):
    assert run(docs(spark, [(5, "abcdefgh", "en", "s", 8)])) == brute([(5, "abcdefgh", "en", "s", 8)])
    assert run(docs(spark, [(None, "x", "en", "s", 1)])) == brute([(None, "x", "en", "s", 1)])
    assert edits_and_neighbours(docs(spark, [])).count() == 0


def test_likeness(spark):
    a, b = Parse().feed(b"").signature(), Parse().feed(b"abc").signature()
    assert likeness(a, a) == 1.0 and likeness(a, b) == 0.0 and likeness(b, b) == 1.0
    f = fingerprint(docs(spark)).withColumnRenamed("fingerprint", "x")
    got = f.select("doc_id", likeness_of("x", "x").alias("l")).collect()
    assert {r.l for r in got} == {1.0}
