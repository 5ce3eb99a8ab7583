"""Every stage of the pipeline against a plain version of it, over a small corpus."""

from collections import Counter

import corpus_pipeline
from loomstone.llm.line_dedup import line_keys
from loomstone.llm.quality import statistics
from loomstone.llm.simhash import shingles
from tests.llm.test_quality import corpus

import numpy as np


def folder(spark, tmp_path):
    rows, labels = corpus(300)
    rows = [(i, t + "\nA line that many share\n" + (rows[i - 1][1] if i % 50 == 2 else ""), "en", f"s{i % 5}", len(t)) for i, t, *_ in rows]
    rows += [(1000 + i, rows[i][1] + " end", "fr", "s9", 1) for i in range(1, 300, 30)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, {i: q for i, q, _ in labels}


def test_stages(spark, tmp_path):
    path, rows, quality = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    before = {r.doc_id: r.text for r in docs.collect()}

    # quality: the same decision as scores one by one, and clean documents stay
    docs1 = corpus_pipeline.keep_quality(spark, docs, path)
    model, _ = corpus_pipeline.quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"), train_on=lambda c: corpus_pipeline.crc_mod(c, 4) != 2)
    want = {i for i, t in before.items() if model.score(np.array([statistics((t or "").encode())]))[0] >= 0.7}
    kept = {r.doc_id: r.text for r in docs1.collect()}
    assert set(kept) == want and docs1.columns == columns
    clean = [i for i, q in quality.items() if q]
    assert sum(i in kept for i in clean) / len(clean) > 0.95
    assert sum(i in kept for i, q in quality.items() if not q) / 75 < 0.1

    # lines: what ten documents share stays once, at its first place
    docs2 = corpus_pipeline.drop_repeated_lines(spark, docs1, path)
    counts = Counter(k for t in kept.values() for k in set(line_keys((t or "").encode())) if k)
    plain, seen = {}, set()
    for i, t in sorted(kept.items()):
        lines = []
        for x, k in zip((t or "").split("\n"), line_keys((t or "").encode()), strict=True):
            if k and counts[k] >= 10:
                if k in seen:
                    continue
                seen.add(k)
            lines.append(x)
        plain[i] = "\n".join(lines)
    got = {r.doc_id: r.text for r in docs2.collect()}
    assert got == plain and docs2.columns == columns
    assert all(r.n_chars == len(r.text) for r in docs2.collect())
    assert sum("A line that many share" in t for t in got.values()) == 1

    # near copies: what is alike by 0.8 or more leaves one, the rest stays
    docs3 = corpus_pipeline.keep_one_of_similar(spark, docs2, path)
    left = {r.doc_id for r in docs3.collect()}
    sets = {i: set(shingles(t.encode(), 5)) for i, t in got.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    ids = sorted(got)
    for b in ids:
        near = [a for a in ids if a < b and alike(a, b) >= 0.9]
        if near:
            assert b not in left
        elif all(alike(a, b) < 0.4 for a in ids if a < b):
            assert b in left
    assert docs3.columns == columns

    # packing
    bins = corpus_pipeline.pack_bins(spark, docs3, path).collect()
    assert Counter({i: len((got[i]).encode().split()) + 1 for i in left}) == sum((Counter({r.doc_id: r.n_tokens}) for r in bins), Counter())
    room = Counter()
    for r in bins:
        room[r.bin_id] += r.n_tokens
    assert max(room.values()) <= 2048

    # all of it
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, bins))


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, ties, very long texts and columns with names that operators use."""
    from pyspark.sql import functions as F

    from tests.llm.helpers import clashing

    path, rows, _ = folder(spark, tmp_path)
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
    odd = [(3000, long, "en", "s1", 1), (3001, long, "en", "s1", 1), (3002, long, None, None, None), (3002, long, None, None, None), (None, long, "en", "s1", 1), (None, None, None, None, None)]
    odd += [(4000 + i, "one line that many have", "en", "s2", 1) for i in range(12)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    df = clashing(df).drop("n_lines", "n_dropped")
    columns, before = df.columns, df.count()

    good = corpus_pipeline.keep_quality(spark, df, path)
    assert good.columns == columns and 0 < good.count() <= before
    lines = corpus_pipeline.drop_repeated_lines(spark, df, path)
    assert lines.columns == columns and lines.count() == before
    texts = {}
    for r in lines.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[3000] == [long] and texts[3002] == [long, long] and texts[4000] == ["one line that many have"]
    assert all(texts[4000 + i] == [""] for i in range(1, 12)) and sorted(texts[None]) == ["", long]
    kept = corpus_pipeline.keep_one_of_similar(spark, lines, path)
    assert kept.columns == columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(3000) == 1 and 3001 not in ids and 3002 not in ids and ids.count(None) == 2 and ids.count(4000) == 1
    assert sum(i in ids for i in [2000, 2001, *range(4001, 4012)]) == 1  # texts without words
    bins = corpus_pipeline.pack_bins(spark, df, path)
    assert bins.agg(F.sum("n_tokens")).first()[0] == sum(len((r.text or "").encode().split()) + 1 for r in df.select("text").collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
