import random
from collections import defaultdict

from loomstone.llm.packing import best_fit, pack
from tests.llm.helpers import EDGE, clashing, docs


def naive(rows, capacity):
    """Looks at every open bin for every piece."""
    out, pieces, bins = [], [], []
    for i, (size, _, _) in enumerate(rows):
        full = size // capacity if size > capacity else 0
        for p in range(full):
            out.append((i, p, p * capacity, capacity, len(bins)))
            bins.append(None)
        if size > full * capacity:
            pieces.append((size - full * capacity, i, full))
    for size, i, p in sorted(pieces, key=lambda x: (-x[0], x[1])):
        _, s, c = rows[i]
        fits = [(b[0], k) for k, b in enumerate(bins) if b and b[0] >= size and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= size
        bins[k][1].add(s)
        bins[k][2].add(c)
        if not bins[k][0]:
            bins[k] = None
        out.append((i, p, p * capacity, size, k))
    return out


def test_against_a_look_at_every_bin():
    rng = random.Random(2)
    for n in (0, 1, 40, 400):
        rows = [(rng.choice([1, 5, 30, 64, 100, 101, 350]) + rng.randrange(40), rng.choice([None, "a", "a", "a", *"bcdefgh"]), rng.choice([None, 1, 1, *range(50)])) for _ in range(n)]
        assert sorted(best_fit(rows, 100)) == sorted(naive(rows, 100))


def check(out, rows, capacity):
    bins, tokens = defaultdict(list), defaultdict(int)
    for r in out:
        bins[r.bin_id].append(r)
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for i, t, *_ in rows:
        want[i] += len((t or "").encode().split()) + 1
    assert tokens == want
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity
        known = [r.source for r in b if r.source is not None]
        assert len(known) == len(set(known))
    return bins


def test_edge_rows(spark):
    check(pack(clashing(docs(spark)), capacity=100).collect(), EDGE, 100)
    check(pack(docs(spark)).collect(), EDGE, 2048)
    assert pack(docs(spark, [])).count() == 0


def test_hot_source_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, "same words here" if i % 3 == 0 else " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))), "en", "hot" if i % 3 else f"s{i % 40}", 1) for i in range(900)]
    out = pack(docs(spark, rows), capacity=64, shard_rows=200).collect()
    text = {i: t for i, t, *_ in rows}
    for b in check(out, rows, 64).values():
        same = [r for r in b if text[r.doc_id] == "same words here"]
        assert len(same) <= 1


def test_repeated_rows_are_spread_and_never_share_a_bin(spark):
    rows = [(None, "", None, "one", 0)] * 300
    out = pack(docs(spark, rows), shard_rows=50).collect()
    assert len(out) == len({r.bin_id for r in out}) == 300
    assert max(len([1 for r in out if r.bin_id >> 32 == k]) for k in range(6)) < 100


def test_given_clusters(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text number {i}", "en", None, 1) for i in range(40)]
    df = docs(spark, rows).withColumn("component_id", F.when(F.col("doc_id") < 10, F.lit(3)).when(F.col("doc_id") < 20, F.col("doc_id")))
    out = pack(df, capacity=100, cluster_col="component_id").collect()
    assert sum(r.n_tokens for r in out) == 160
    alike = [r.bin_id for r in out if r.doc_id < 10]
    assert len(set(alike)) == 10
    assert len({r.bin_id for r in out}) == 10
