import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomstone.llm.common import crc_mod
from loomstone.llm.quality import STATISTICS, classify, fit, keep_good, learn, statistics
from tests.llm.helpers import EDGE, clashing, docs


def corpus(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 150))]
        good = i % 4 != 0
        text = " ".join(words).capitalize() + "." if good else rng.choice([" ".join(w + "$$$" for w in words), "!! ".join(words).upper(), " | ".join(words), " ".join(w for w in words for _ in range(6))])
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = classify(docs(spark, rows), lab, train_on=lambda c: crc_mod(c, 4) != 2).collect()
    want = {i: q for i, q, _ in labels}
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == len(rows) and len(held) > 50
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    run = lambda x: {r.doc_id: r.score for r in classify(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int"), train_on=lambda c: crc_mod(c, 4) != 2).collect()}
    a, b = run(labels), run(flipped)
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_density_ratio_by_hand():
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    x = [rng.normal(size=(300, d)), rng.normal(1.0, 2.0, size=(500, d))]
    m = fit(np.array([300.0, 500.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.2, 0.1)
    q = rng.normal(size=(5, d))
    logs = []
    covs = [np.cov(v.T, bias=True) for v in x]
    pooled, floor = (300 * covs[0] + 500 * covs[1]) / 800, 1e-3 * np.cov(np.concatenate(x).T, bias=True).diagonal() + 1e-6
    for k in (0, 1):
        cov = 0.8 * covs[k] + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(cov.diagonal()) + np.diag(floor)
        diff = q - x[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(501 / 301))))
    assert np.allclose(m.score(q), want)


def test_edge_rows(spark):
    lab = spark.createDataFrame([(1, 0), (2, 1), (4, None), (6, 1), (None, 0), (77, 1), (4, 3)], "doc_id long, quality int")
    out = classify(clashing(docs(spark)), lab).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs(spark), none).collect()} == {0.5}
    assert classify(docs(spark, []), lab).count() == 0
    model, _ = learn(docs(spark), lab)
    kept = keep_good(clashing(docs(spark)), model, threshold=0.0)
    assert kept.count() == len(EDGE)
    assert keep_good(docs(spark, []), model).count() == 0


def test_statistics_are_finite():
    for t in (b"", b" ", b"\n\n", b"x", b"\x00", "é".encode(), b"a" * 10**6, b"!!!! ????"):
        assert len(statistics(t)) == len(STATISTICS) and np.isfinite(statistics(t)).all()


def test_ids_are_text(spark):
    got = spark.range(50).select("id", crc_mod("id", 4).alias("r"), F.lit(1)).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def plain_statistics(text):
    """The same from the definitions, character by character."""
    size, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x]
    n = len(words)
    count = lambda chars: sum(c in chars for c in text)
    share = lambda x, of, more, prior=0.0: math.sqrt((x + prior * more) / (of + more))
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in text)
    entropy = -sum(c / size * math.log2(c / size) for c in Counter(text).values()) if size else 0.0
    return [
        math.log(1 + n),
        math.log(1 + (sum(map(len, words)) + 100) / (n + 20)),
        share(sum(65 <= c <= 90 for c in text), letters, 100, 0.03),
        share(count(b"#$%&*+=@\\^_~`"), size, 20),
        share(count(b"!"), size, 20),
        share(count(b"|"), size, 20),
        share(count(b"0123456789"), size, 100),
        share(sum(words[i] == words[i - 1] for i in range(1, n)), n, 5),
        math.log(21 + len(set(words))) / math.log(21 + n),
        share(len(lines) - len(set(lines)), len(lines), 20),
        share(count(b".,;:"), size, 100, 0.02),
        (size * entropy + 2100) / (size + 500),
        share(sum(len(w) < 4 for w in words), n, 20, 0.3),
        share(sum(len(w) > 15 for w in words), n, 20, 0.02),
        (math.log(1 + max((len(x) for x in lines), default=0)) - math.log(1 + size)) * size / (size + 500),
        share(count(b"<>{}[]/"), size, 100),
    ]


def test_statistics_against_a_plain_version():
    texts = [(t or "").encode() for _, t, *_ in EDGE] + [t.encode() for _, t, *_ in corpus(60)[0]] + [b"<a href='x'>#1 100% | b!</a>\n\nsame\nsame\n"]
    for t in texts:
        assert np.allclose(statistics(t[:20_000]), plain_statistics(t[:20_000]))


def test_only_labelled_rows_are_measured(spark):
    rows, labels = corpus(300)
    some = spark.createDataFrame([x for x in labels if x[0] % 5 == 0], "doc_id long, quality int, toxic int")
    a, every = learn(docs(spark, rows), some)
    b, few = learn(docs(spark, rows), some, every=False)
    assert np.allclose(a.means, b.means) and np.allclose(a.inverses, b.inverses)
    assert every.count() == 300 and 60 <= few.count() < 80
