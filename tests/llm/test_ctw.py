import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm.common import crc_mod
from loomstone.llm.ctw import SPLIT, Subtrees, Table, Upper, gram_logs, least_count, log_gamma, log_kt, score_texts, sequence, tokens
from tests.llm.helpers import EDGE, clashing, docs


def tree_counts(seqs, depth):
    """Counts of the byte values after each context, a byte string that ends just before them."""
    out = {}
    for s in seqs:
        padded = b"\n" * depth + s
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                out.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    return out


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Slow:
    """Context-tree weighting by recursion over Python dicts."""

    def __init__(self, seqs, depth):
        self.depth, self.counts = depth, tree_counts(seqs, depth)
        self.children = {}
        for c in self.counts:
            if c:
                self.children.setdefault(c[1:], []).append(c)
        self.known = {}

    def decision(self, context, bits):
        lo, width = 0, 256
        for x in bits:
            width //= 2
            lo += x * width
        n = self.counts.get(context, {})
        ones = sum(v for k, v in n.items() if lo + width // 2 <= k < lo + width)
        return sum(v for k, v in n.items() if lo <= k < lo + width) - ones, ones

    def log_pw(self, context, bits):
        if (context, bits) not in self.known:
            own = kt(*self.decision(context, bits))
            if len(context) < self.depth:
                below = sum(self.log_pw(c, bits) for c in self.children.get(context, []))
                own = np.logaddexp(own, below) - math.log(2)
            self.known[context, bits] = own
        return self.known[context, bits]

    def one(self, history, d, bits):
        context = history[len(history) - d :]
        a, b = self.decision(context, bits)
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth or not sum(self.decision(history[len(history) - d - 1 :], bits)):
            return own
        stop = math.exp(kt(a, b) - math.log(2) - self.log_pw(context, bits))
        return stop * own + (1 - stop) * self.one(history, d + 1, bits)

    def score(self, s):
        padded, total = b"\n" * self.depth + s, 0.0
        for i in range(self.depth, len(padded)):
            bits = ()
            for k in range(7, -1, -1):
                x = padded[i] >> k & 1
                one = self.one(padded[:i], 0, bits)
                total += math.log10(one if x else 1 - one)
                bits += (x,)
        return total


TEXTS = [b"the cat sat on the mat", b"a cat and a hat", b"the hat", "çà et là, ça".encode(), b"zzz zzz zzz the", b"", b"the rat sat on a bat", "naïve çà".encode(), b"qqqq"]


@pytest.mark.parametrize("depth, head", [(1, 1 << 20), (2, 3), (3, 1 << 20), (5, 1 << 20), (5, 20), (6, 0)])
def test_scores_are_the_recursive_mixture(spark, depth, head):
    """End to end: grams counted, trees trained and texts scored in Spark, against the recursion."""
    rows = [(i, t.decode(), "en", "s", 1) for i, t in enumerate(TEXTS * 2)]
    out = score_texts(docs(spark, rows), F.col("doc_id") < 6, depth=depth, head_grams=head).collect()
    slow = Slow([sequence(tokens(t)) for t in TEXTS[:6]], depth)
    for r in out:
        assert r.score == pytest.approx(slow.score(sequence(tokens(TEXTS[r.doc_id % len(TEXTS)]))), rel=1e-6)


def test_all_contexts_count(spark):
    """Contexts that occur once, tens of thousands of them, are all in the model, over several chunks and partitions."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 600, np.uint8)) for _ in range(40)]
    rows = [(i, t.decode(), "en", "s", 1) for i, t in enumerate(texts)]
    slow = Slow([sequence(tokens(t)) for t in texts], 4)
    assert len(slow.counts) > 20_000
    out = score_texts(docs(spark, rows), F.lit(True), depth=4, head_grams=1000).filter("doc_id < 3").collect()
    for r in out:
        assert r.score == pytest.approx(slow.score(sequence(tokens(texts[r.doc_id]))), rel=1e-6)


def test_probabilities_sum_to_one(spark):
    text = b"abracadabra " * 20 + b"alakazam"
    counts = tree_counts([text], 3)
    number = lambda c, b: sum(x << 8 * (1 + k) for k, x in enumerate(c)) | b
    for context in (b"bra", b"xyz", b"zra", b"abr"):
        grams = {number(c, b): n for c, v in counts.items() if len(c) == 3 for b, n in v.items()}
        grams |= {k: grams.get(k, 0) for k in (number(context, b) for b in range(256))}
        found = gram_logs(spark.createDataFrame([(k, 1, n) for k, n in grams.items()], "g long, n long, t long"), 3).collect()
        assert len(found) == len(grams)
        p = {r.g: 10**r.l for r in found}
        assert sum(p[number(context, b)] for b in range(256)) == pytest.approx(1, abs=1e-6)


def test_depth(spark):
    for depth in (0, 7):
        with pytest.raises(ValueError):
            gram_logs(spark.createDataFrame([], "g long, n long, t long"), depth)


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = Table(keys, np.arange(len(keys)) + 1.0)
    got, lost = table.find(np.r_[keys, keys + 1])
    assert (got[: len(keys)] == np.arange(len(keys)) + 1).all() and not lost[: len(keys)].any()
    other = ~np.isin(keys + 1, keys)
    assert (lost[len(keys) :] == other).all() and (got[len(keys) :][other] == 0).all()
    empty = Table(np.empty(0, np.int64), np.empty(0))
    assert empty.find(keys)[1].all()


def test_one_subtree_or_several_are_alike():
    g = np.unique(np.random.default_rng(2).integers(0, 1 << 10, 400)) * 0x0101010101 & (1 << 48) - 1
    g = np.unique(g)
    t = np.arange(len(g)) % 4
    whole = Subtrees(g, t, 5, SPLIT)
    upper = Upper(*whole.tops(), SPLIT)
    logs = whole.logs(upper)
    top = g >> 24
    for k in np.unique(top)[:20]:
        part = Subtrees(g[top == k], t[top == k], 5, SPLIT)
        assert np.allclose(part.logs(upper), logs[top == k])


def test_gamma_and_kt():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e8])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-8, atol=1e-8)
    assert math.exp(log_kt(np.array([0.0]), np.array([0.0]))[0]) == pytest.approx(1)
    assert math.exp(log_kt(np.array([1.0]), np.array([1.0]))[0]) == pytest.approx(1 / 8)


def base(rows, chosen):
    counts = Counter(w for (i, t, *_), c in zip(rows, chosen, strict=True) if c for w in tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in rows:
        w = tokens((t or "").encode())
        out.append((str(i), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    return sorted(out)


@pytest.mark.parametrize("head", [1 << 17, 2])
def test_edge_rows(spark, head):
    chosen = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, *_ in EDGE]
    out = score_texts(clashing(docs(spark)), crc_mod("doc_id", 10) != 0, head_words=head).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == base(EDGE, chosen)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in out)


def test_rare_words_and_held_out(spark):
    rows = [(i, " ".join(f"word{(i * j) % 61} the of" for j in range(1, 40)), "en", "s", 1) for i in range(80)]
    chosen = [zlib.crc32(str(i).encode()) % 10 != 0 for i, *_ in rows]
    out = score_texts(docs(spark, rows), crc_mod("doc_id", 10) != 0, head_words=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == base(rows, chosen)
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert held and all(r.score > r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    out = score_texts(docs(spark), F.lit(False)).collect()
    assert len(out) == len(EDGE) and {r.train_tokens for r in out} == {0} and {r.n_known for r in out} == {0}
    assert all(r.bits_per_byte == pytest.approx(8, abs=1e-3) for r in out)
    assert score_texts(docs(spark, []), F.lit(True)).count() == 0


def test_threshold(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5] * 10 + [7] * 3 + [100])], "k int, n long")
    assert least_count(df, 14) == 5 and least_count(df, 13) == 7 and least_count(df, 1) == 100
    assert least_count(df, 0) > 100
