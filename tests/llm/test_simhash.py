import random

import numpy as np
import xxhash

from loomstone.llm.components import components
from loomstone.llm.similar import similar_groups
from loomstone.llm.simhash import fingerprint, keep_one, near_groups
from tests.llm.helpers import EDGE, clashing, docs


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(ids, linked):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(ids)):
        members.setdefault(root(i), []).append(ids[i])
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(ids))]


def brute(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return sorted(zip(map(str, ids), (f"{f:016x}" for f in fps), map(str, grouped(ids, links)), strict=True))


def run(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_groups(df).collect())


def test_edge_rows(spark):
    assert run(docs(spark)) == brute(EDGE)


def test_near_texts_in_large_buckets(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(1000 + i, f"quite another text number {i} " * 3, "en", "s", 1) for i in range(40)]
    got = run(docs(spark, rows))
    assert got == brute(rows)
    assert len({g[2] for g in got}) < 200


def test_clash_and_empty(spark):
    assert run(clashing(docs(spark)).drop("fingerprint", "component_id")) == brute(EDGE)
    assert near_groups(docs(spark, [])).count() == 0
    assert similar_groups(docs(spark, [])).count() == 0


def test_a_heavy_bucket_is_dealt_again(spark, monkeypatch):
    from loomstone.llm import simhash

    monkeypatch.setattr(simhash, "HEAVY", 3)
    rng = np.random.default_rng(0)
    fps = []
    for _ in range(40):
        f = int(rng.integers(0, 2**63))
        fps += [f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (0, 1, 2, 3)]
    fps = list(dict.fromkeys(x - (1 << 64) if x >> 63 else x for x in fps))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "_fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    index = {f: i for i, f in enumerate(fps)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3]
    want = grouped(fps, links)
    same = lambda label: {frozenset(k for k in fps if label(k) == v) for v in map(label, fps)}
    assert same(lambda f: got.get(f, f)) == same(lambda f: want[index[f]])


def test_similar_texts_leave_one(spark):
    rng = random.Random(7)
    rows, families = [], {}
    for i in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(120)]
        rows.append((i * 10, " ".join(words), "en", "s", 1))
        families[i * 10] = i * 10
        for copy in range(1, rng.randrange(4)):
            edited = list(words)
            edited[rng.randrange(120)] = "changed"  # 5 of some 121 shingles
            rows.append((i * 10 + copy, " ".join(edited), "en", "s", 1))
            families[i * 10 + copy] = i * 10
    df = docs(spark, rows)
    groups = similar_groups(df)
    assert {r.doc_id: r.component_id for r in groups.collect()} == families
    assert sorted(r.doc_id for r in keep_one(df, groups).collect()) == [i * 10 for i in range(60)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (100, 9)] + [(200 + i, 201 + i) for i in range(64)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 8, 100: 8} | {201 + i: 200 for i in range(64)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_leave_no_tables_behind(spark):
    from pathlib import Path

    from loomstone.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "loomstone"
    tables = lambda: set(folder.iterdir()) if folder.exists() else set()
    before = tables()
    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"))
    assert got.count() == 100
    assert len(tables() - before) == 1  # the result's


def test_one_fingerprint():
    for t in ("a b c d", "A B", "", "x", "one two three one two three"):
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def exact_groups(rows, least=0.8):
    """component_id by the Jaccard similarity of all pairs, and the similarities."""
    from loomstone.llm.simhash import shingles

    sets = [set(shingles(t.encode(), 5)) for _, t, *_ in rows]
    alike = {(i, j): len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i)}
    return dict(zip([r[0] for r in rows], grouped([r[0] for r in rows], [p for p, s in alike.items() if s >= least]), strict=True)), alike


def test_a_repeated_line_does_not_link(spark):
    rng = random.Random(3)
    line = " ".join(f"same{i}" for i in range(10))
    rows = [(i, "\n".join([" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)), *[line] * 8]), "en", "s", 1) for i in range(40)]
    assert {r.doc_id: r.component_id for r in similar_groups(docs(spark, rows)).collect()} == {i: i for i in range(40)}


def edited_copies(seed, families=120, words=100):
    rng = random.Random(seed)
    rows = []
    for i in range(families):
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        rows.append((2 * i, " ".join(text), "en", "s", 1))
        at = rng.randrange(words - 14)
        rows.append((2 * i + 1, " ".join(text[:at] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 9))] + text[at + rng.randrange(3, 9) :]), "en", "s", 1))
    return rows


def test_pairs_just_over_and_under_the_rule(spark, monkeypatch):
    from loomstone.llm import similar

    rows = edited_copies(1)
    want, alike = exact_groups(rows)
    assert sum(0.8 <= s <= 0.85 for s in alike.values()) >= 20 and sum(0.7 <= s < 0.8 for s in alike.values()) >= 5
    run = lambda: {r.doc_id: r.component_id for r in similar_groups(docs(spark, rows)).collect()}
    assert run() == want
    rows = [(i, t + " this passage is in all of them", *x) for i, t, *x in rows]
    want, _ = exact_groups(rows)
    assert run() == want
    monkeypatch.setattr(similar, "CROWDED", 1)  # all shared keys come last
    assert run() == want
    monkeypatch.setattr(similar, "TILE", 7)
    assert run() == want


def test_a_large_group_in_tiles(spark, monkeypatch):
    """A chain of near copies of one text: few of its pairs are links, and a shingle that all have is dealt into tiles."""
    from loomstone.llm import similar

    monkeypatch.setattr(similar, "TILE", 16)
    rng = random.Random(11)
    rows, text = [], [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(150):
        rows.append((i, " ".join(text), "en", "s", 1))
        text[(i * 7) % 140] = f"v{rng.randrange(10**6)}"
    rng.shuffle(rows)
    want, alike = exact_groups(rows)
    assert {r.doc_id: r.component_id for r in similar_groups(docs(spark, rows)).collect()} == want
    assert sum(s < 0.8 for s in alike.values()) > len(alike) / 2


def test_similar_edge_rows(spark):
    from loomstone.llm.simhash import shingles

    sets = [frozenset(shingles((t or "").encode(), 5)) for _, t, *_ in EDGE]
    ids = [r[0] for r in EDGE]
    want = grouped(ids, [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in similar_groups(clashing(docs(spark)).drop("component_id")).collect())
    assert got == sorted(zip(map(str, ids), map(str, want), strict=True))


def test_pivot_tables_discard_pairs():
    from loomstone.llm.similar import PARITY, Run, parity_bits

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 30, np.uint64)) for _ in range(200)]
    bits = np.stack([np.frombuffer(parity_bits(s), np.uint64) for s in sets])
    assert bits.shape == (200, PARITY // 64)
    run = Run(0.8, np.full(200, 30), bits, np.full(200, None), np.array([s.tobytes() for s in sets], object))
    far = np.abs(run.table[:, None] - run.table[None]).max(axis=2) > 60 * 0.2 / 1.8
    assert far[np.triu_indices(200, 1)].mean() > 0.9
    i, j = np.triu_indices(200, 1)
    assert len(run.alike(i, j)) == 0


def test_bloom_filters(spark):
    from loomstone.llm import bloom

    rng = np.random.default_rng(8)
    keys = rng.integers(-(2**63), 2**63, 20_000)
    sent = bloom.filter_of(spark.createDataFrame([(int(k),) for k in keys], "k long"), len(keys))
    held = np.frombuffer(sent.value, np.uint8)
    assert bloom.has(held, keys.view(np.uint64)).all()
    assert bloom.has(held, rng.integers(-(2**63), 2**63, 20_000).view(np.uint64)).mean() < 0.01
    assert bloom.size_for(0) == bloom.LEAST_BITS and bloom.size_for(1 << 40) == bloom.MOST_BITS


def test_wide_bitmaps_of_long_texts(spark):
    """Long texts: bitmaps that differ in half of their bits say nothing, larger ones do; folding gives the smaller bitmap."""
    from loomstone.llm.similar import PARITY, parity_bits, wide_bits, wide_distance

    rng = np.random.default_rng(6)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, np.uint64)) for _ in range(2))
    assert wide_bits(a[:PARITY]) is None and len(wide_bits(a)) == 512
    assert wide_distance(wide_bits(a), parity_bits(b, 1024)) == wide_distance(parity_bits(a, 1024), parity_bits(b, 1024))
    near = np.unique(np.r_[a[:2800], b[:200]])
    assert wide_distance(wide_bits(a), wide_bits(near)) <= len(np.setxor1d(a, near)) < 0.111 * 6000 < wide_distance(wide_bits(a), wide_bits(b))
    r = random.Random(1)
    rows, words = [], []
    for i in range(12):
        if i % 3 == 0:
            words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
        text = ["a passage that they all share here", *words]
        for _ in range(40 * (i % 3)):
            text[r.randrange(1, len(text))] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "s", 1))
    want, _ = exact_groups(rows)
    assert {x.doc_id: x.component_id for x in similar_groups(docs(spark, rows)).collect()} == want


def test_near_fingerprints_bring_similar_texts_together(spark, monkeypatch):
    """All pairs of sets within three bits come by SimHash and pivot tables and only so; the other alike ones by shingles."""
    from loomstone.llm import similar

    rng = random.Random(21)
    rows = edited_copies(5, 40)
    for i in range(40):
        text = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(1000 + 2 * i, " ".join(text), "en", "s", 1), (1001 + 2 * i, " ".join([*text[:-1], "changed"]), "en", "s", 1)]
    want, alike = exact_groups(rows)
    fps = [similar.set_fingerprint(similar.shingle_set(t.encode(), 5)) & (1 << 64) - 1 for _, t, *_ in rows]
    near = {p for p in alike if (fps[p[0]] ^ fps[p[1]]).bit_count() <= 3}
    linked = {p for p, s in alike.items() if s >= 0.8}
    assert len(near & linked) >= 20 and len(linked - near) >= 20
    run = lambda: {r.doc_id: r.component_id for r in similar_groups(docs(spark, rows)).collect()}
    ids = [r[0] for r in rows]
    assert run() == want
    monkeypatch.setattr(similar, "near_fingerprints", lambda nodes: spark.createDataFrame([], similar.EDGES))
    assert run() == dict(zip(ids, grouped(ids, list(linked - near)), strict=True))
