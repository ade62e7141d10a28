"""op3: against brute force over all windows."""

import hashlib

import numpy as np
import pytest

from quarry.llm import phrases, queries
from quarry.llm.common import words_of


def brute(rows, window):
    """{(doc_id, text): (n_words, n_removed, sha)} by comparing every window with every other."""
    first = {}
    for doc_id, text in rows:
        words = words_of(text.encode() if text is not None else None)
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = words_of(text.encode() if text is not None else None)
        gone = np.zeros(len(words), bool)
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < doc_id:
                    gone[i : i + window] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed: int, n: int = 60):
    """Texts of few words with shared passages, whole copies, nested overlaps and repeated lines."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda k: [vocabulary[i] for i in rng.integers(0, 400, k)]
    shared = [draw(int(rng.integers(20, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        words = draw(int(rng.integers(0, 80)))
        for _ in range(rng.integers(0, 3)):
            p = shared[rng.integers(0, 6)]
            a = int(rng.integers(0, len(p)))
            words += p[a:] if rng.random() < 0.5 else p
            words += draw(int(rng.integers(0, 30)))
        rows.append((int(i), " ".join(words)))
    line = " ".join(draw(10))
    rows += [(n, "\n".join([line] * 30)), (n + 1, "\n".join([line] * 25)), (n + 2, rows[5][1]), (n + 3, rows[5][1]), (n + 4, rows[7][1] + " x"), (3, rows[9][1])]
    return rows + [(n + 5, None), (n + 6, ""), (n + 7, " \t\n"), (None, rows[5][1]), (n + 8, "a" * 5000), (n + 9, "é x " * 60), (n + 10, "é x " * 70)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = phrases.remove_repeats(df, shard=4000)
    mine = sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert mine == brute(rows, 50)
    assert any(r[2] for r in mine)


def test_query(spark):
    import conftest

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{conftest.SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_phrases(spark, conftest.SMALL)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(rows, 50)


def test_other_shapes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.remove_repeats(empty).count() == 0
    text = " ".join(f"v{i}" for i in range(60))
    odd = spark.createDataFrame([(1, text, 5, "x", True), (2, "a  b " + text, 6, "y", None)], "doc_id int, text string, row long, spans string, hit boolean")
    out = {r.doc_id: r for r in phrases.cleaned(odd).collect()}
    assert out[1].text == text and out[2].text == "a b" and out[2].spans == "y" and out[2].row == 6
