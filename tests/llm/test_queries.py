"""The registered queries, and those with SQL against DuckDB, over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_one_query_for_each_operator():
    from loomstone.llm.queries import CATALOGUE

    assert sorted(int(n[2:].split("_")[0]) for n in CATALOGUE.queries) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_ego_embedding_dedup", "op10_warc_revisits"])
def test_against_sql(spark, name):
    import duckdb

    from loomstone.llm.queries import CATALOGUE

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = CATALOGUE.queries[name](spark, SF)
    cols = sorted(got.columns)
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({CATALOGUE.sql[name]})").fetchall(), key=str)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == want


def _rows():
    import duckdb

    return duckdb.connect().sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()


def _query(spark, name, folder=SF):
    from loomstone.llm.queries import CATALOGUE

    return CATALOGUE.queries[name](spark, str(folder)).collect()


def test_op2_against_all_pairs(spark):
    from tests.llm.test_simhash import brute

    got = _query(spark, "op2_simhash_near_dedup")
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(_rows())


def test_op3_on_held_out_labels(spark):
    import zlib

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = _query(spark, "op3_quality_classifier")
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in _rows())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 10 and sum(held) >= 0.9 * len(held)


def test_op4_against_whole_parses(spark):
    from tests.llm.test_lz_fingerprint import brute

    got = _query(spark, "op4_lz_fingerprint")
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == brute(_rows())


def test_op5_against_tiktoken(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    from loomstone.llm import byte_bpe
    from tests.llm.helpers import sha

    codec = byte_bpe.Codec(open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    want = sorted((i, len(x := ref.encode_ordinary(t or "")), sha(",".join(map(str, x))), sha(t or "")) for i, t, *_ in _rows())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in _query(spark, "op5_byte_bpe")) == want


def test_op6_against_sql_where_vectors_are_near(spark, tmp_path):
    import duckdb

    from loomstone.llm.queries import CATALOGUE
    from tests.llm.test_ego_join import clustered

    rows = clustered(300, d=16, spread=0.12) + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 16), (904, [1.0] * 16)]
    spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({CATALOGUE.sql['op6_ego_embedding_dedup']})").fetchall()
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in _query(spark, "op6_ego_embedding_dedup", tmp_path)]
    assert sorted(got) == sorted(want) and 20 < sum(r[3] for r in want) < 250


def test_op7_against_recursion(spark, tmp_path):
    import zlib

    from loomstone.llm.ctw import DEPTH
    from tests.llm.test_ctw import Slow, base, sequence, tokens

    rows = [(i, f"the {w} sat on the {v}" * (i % 3 + 1), "en", "s", 1) for i, (w, v) in enumerate((a, b) for a in ("cat", "rat", "Bat") for b in ("mat", "hat", "roof\n", "")) if i] + [(50, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    chosen = [zlib.crc32(str(i).encode()) % 10 != 0 for i, *_ in rows]
    slow = Slow([sequence(tokens((t or "").encode())) for (_, t, *_), c in zip(rows, chosen, strict=True) if c], DEPTH)
    got = _query(spark, "op7_ctw_scoring", tmp_path)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows, chosen)
    assert {r.doc_id: r.held_out for r in got} == {r[0]: not c for r, c in zip(rows, chosen, strict=True)}
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        assert r.score == pytest.approx(slow.score(sequence(tokens(texts[r.doc_id]))), rel=1e-6)


def test_op8_holds_every_token_without_conflicts(spark):
    from tests.llm.test_packing import check

    bins = check(_query(spark, "op8_best_fit_packing"), _rows(), 2048)
    words = {i: tuple((t or "").lower().split()) for i, t, *_ in _rows()}
    for b in bins.values():
        whole = [words[r.doc_id] for r in b]
        assert len(set(whole)) == len({r.doc_id for r in b})


def test_op9_against_all_parts_and_templates(spark):
    from tests.llm.test_licenses import brute

    files = [(i, f"{source}/{lang}/{i}", t) for i, t, lang, source, _ in _rows()]
    got = _query(spark, "op9_license_scan")
    assert sorted(((r.doc_id, r.license, round(r.score, 9), r.origin, r.license_path) for r in got), key=str) == brute(files)
    assert {r.origin for r in got} == {"header", "none"}
