import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstone.llm.licenses import LICENCE_FILE, NOTICES, RARE, Index, Weights, directory, scan_licenses, terms, whole_texts
from tests.llm.helpers import EDGE, clashing, docs

WHOLE = dict(whole_texts())
MIT, GPL = "Permission is hereby granted, free of charge", "This work is licensed under the GNU General Public License, version 3."
APACHE = dict(NOTICES)["Apache-2.0"]
PROSE = "def main(argument):\n    for line in reader:\n        total = total + weight[line]\n    return total\n"


def plain_terms(text):
    out = []
    for word in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text):
        if word:
            out.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
    return out


def brute(files):
    """(license, score, origin, license_path) of each file, by comparing all parts with all templates."""
    texts = [t or "" for *_, t in files]
    n = len(texts)
    df = Counter(t for x in texts for t in set(plain_terms(x)))
    idf = lambda t: math.log((1 + n) / (1 + max(df[t], n / RARE))) + 1
    vec = lambda text: {t: (1 + math.log(c)) * idf(t) for t, c in Counter(plain_terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    notices, wholes = [(k, vec(x)) for k, x in NOTICES], [(k, vec(x)) for k, x in whole_texts()]

    def best(part, templates, least):
        v, top = vec(part), (0.0, None)
        for k, w in templates:
            dot = sum(x * w.get(t, 0.0) for t, x in v.items())
            if dot and dot / (norm(v) * norm(w)) >= least and dot / (norm(v) * norm(w)) > top[0] + 1e-12:
                top = dot / (norm(v) * norm(w)), k
        return top

    own = []
    for _, path, text in files:
        text = text or ""
        score, name = best(text, wholes, 0.8)
        origin = "file"
        if name is None:
            called = path is not None and bool(re.match(r"(.*/)?(licen[cs]e|copying)", path, re.I))
            parts = [*text.split("\n"), *re.split(r"\n\s*\n", text), *([text] if called else [])]
            score, name = max((best(p, [*notices, *wholes] if called else notices, 0.7) for p in parts), key=lambda x: x[0])
            origin = "none" if name is None else "file" if called else "header"
        own.append((name, score, origin))
    given = {}
    for (_, path, _), (name, score, origin) in zip(files, own, strict=True):
        if origin == "file" and path is not None:
            folder = path.rpartition("/")[0]
            if folder not in given or (-round(score, 9), path) < given[folder][:2]:
                given[folder] = (-round(score, 9), path, name)
    out = []
    for (i, path, _), (name, score, origin) in zip(files, own, strict=True):
        source = None
        if name is None and path is not None:
            folder = path.rpartition("/")[0]
            while folder and folder not in given:
                folder = folder.rpartition("/")[0]
            if folder in given:
                _, source, name = given[folder]
                origin = "inherited"
        out.append((i, name, round(score, 9), origin, source))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def run(df):
    return sorted(((r.doc_id, r.license, round(r.score, 9), r.origin, r.license_path) for r in scan_licenses(df).collect()), key=str)


def tree(seed, n=220):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    folders = [""]
    for _ in range(25):
        folders.append(f"{rng.choice(folders)}/d{rng.randrange(100)}".lstrip("/"))
    files = []
    for i in range(n):
        folder = rng.choice(folders[1:])
        text = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(rng.randrange(1, 9)))
        kind = rng.randrange(12)
        name = f"f{i}.py"
        if kind == 0:
            name, text = rng.choice(["LICENSE", "COPYING.txt", "licence.md"]) + ("" if rng.random() < 0.5 else f".{i}"), rng.choice(list(WHOLE.values()))
        elif kind == 1:
            text = rng.choice(NOTICES)[1] + "\n" + text
        elif kind == 2:
            name, text = f"LICENSE-{i}", "Copyright somebody\n\n" + rng.choice(NOTICES)[1]
        elif kind == 3:
            text = rng.choice(NOTICES)[1]
        elif kind == 4:
            text = "Copyright (c) somebody\n\n" + WHOLE[rng.choice(["MIT", "BSD-3-Clause", "ISC"])]
        files.append((i, f"{folder}/{name}".lstrip("/") if rng.random() > 0.02 else None, text if rng.random() > 0.02 else None))
    return files


@pytest.mark.parametrize("seed", [1, 2])
def test_a_random_tree(spark, seed):
    files = tree(seed)
    want = brute(files)
    assert run(frame(spark, files)) == want
    origins = Counter(w[3] for w in want)
    assert min(origins[k] for k in ("file", "header", "inherited", "none")) >= 2


def test_whole_texts_are_licence_files_under_any_name(spark):
    rows = [(i, f"some/{k}/text{i}", "Copyright 2001 somebody\n\n" + t) for i, (k, t) in enumerate(WHOLE.items())]
    rows += [(100 + i, f"some/{k}/code.py", PROSE) for i, k in enumerate(WHOLE)]
    rows += [(200, "other/code.py", PROSE)]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    for i, k in enumerate(WHOLE):
        assert (got[i].license, got[i].origin) == (k, "file"), k
        assert (got[100 + i].license, got[100 + i].origin, got[100 + i].license_path) == (k, "inherited", rows[i][1])
    assert (got[200].license, got[200].origin, got[200].score) == (None, "none", 0.0)


def test_notices_are_headers_and_pass_nothing_on(spark):
    rows = [(i, f"n{i}/x.py", text) for i, (_, text) in enumerate(NOTICES)]
    rows += [(100 + i, f"m{i}/x.py", f"# {text}\n\n{PROSE}") for i, (_, text) in enumerate(NOTICES)]
    rows += [(200 + i, f"{d}{i}/y.py", PROSE) for i in range(len(NOTICES)) for d in "nm"]
    got = scan_licenses(frame(spark, rows)).collect()
    for r in got:
        assert (r.license, r.origin) == ((None, "none") if r.doc_id >= 200 else (NOTICES[r.doc_id % 100][0], "header")), r


def test_a_licence_file_may_hold_a_notice(spark):
    rows = [(1, "a/LICENSE", APACHE), (2, "a/b/x.py", PROSE), (3, "a/b/NOTES", APACHE), (4, "a/b/c/y.py", PROSE), (5, "z", None)]
    got = {r.doc_id: (r.license, r.origin, r.license_path) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None), 2: ("Apache-2.0", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "header", None),
        4: ("Apache-2.0", "inherited", "a/LICENSE"), 5: (None, "none", None),
    }


def test_names():
    for p in ("LICENSE", "a/licence.txt", "COPYING", "x/COPYING.LESSER", "UNLICENSE", "LICENSE-MIT", "MIT-LICENSE.txt", "licenses.md"):
        assert LICENCE_FILE.fullmatch(p), p
    for p in ("licenser.py", "a/LICENSE/x.py", "my_copying.c", "src16/en/156", "license_scan.py2/x"):
        assert not LICENCE_FILE.fullmatch(p), p


def test_anchors_never_hide_a_match():
    every = sorted({t for _, x in (*NOTICES, *whole_texts()) for t in terms(x.encode())})
    weights = Weights({t: 1000 - i % 1000 for i, t in enumerate(every)}, 1001)
    for templates in (NOTICES, whole_texts()):
        index = Index(templates, weights, 0.7)
        for k, (_, x) in enumerate(templates):
            words = terms(x.encode())
            vector = weights.vector(words)
            left = [t for t in vector if t not in index.anchors]
            assert sum(vector[t] ** 2 for t in left) < 0.49 * sum(w * w for w in vector.values()), k
            assert index.best(words)[0] > 0.999


def test_directories(spark):
    rows = spark.createDataFrame([("a/b/c",), ("c",), (None,)], "p string")
    assert [r.d for r in rows.select(directory(rows.p).alias("d")).collect()] == ["a/b", "", None]


def test_edge_rows(spark):
    df = clashing(docs(spark)).withColumn("path", F.concat_ws("/", "source", "doc_id"))
    assert scan_licenses(df).count() == len(EDGE)
    assert scan_licenses(frame(spark, [])).count() == 0
    files = tree(3, 40)
    assert len(run(frame(spark, files + files))) == 2 * len(files)
