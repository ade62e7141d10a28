"""op2, op4, op5, op9: against plain Python and the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SMALL, compare

from quarry.llm import bpe, chat, licenses, packing, queries


# op2


def test_chat_sql(spark):
    compare(spark, queries.op2_chat, queries.ORACLES["op2_chat"], SMALL)


def brute_chat(rows, scene=("system",), segment=chat.SEGMENT):
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        for me in sorted({r[2] for r in turns if r[2] is not None and r[2] not in scene}):
            begin, lots = 0, {}
            for _, _, who, said in turns:
                lots.setdefault(begin // segment, []).append((who, said))
                begin += len(said or "") + len(who or "") + 34
            out += [(conv, me, k, len(t), *chat.render(t, me, scene)) for k, t in lots.items()]
    return sorted(out, key=str)


def test_chat_many_parties(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "x" * 50), (1, 3, "cat", "tie"), (1, 3, "cat", "tie"), (1, None, "bob", "first?")]
    rows += [(2, i, f"p{i % 4}", f"turn {i} é") for i in range(200)] + [(3, 0, None, "nobody"), (3, 1, "system", "scene")] + [(None, 0, "ann", "lost"), (None, 1, "bob", "too")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv long, turn long, speaker string, said string, text string").repartition(5)
    got = chat.perspectives(df, "conv", "turn", "speaker", "said", segment=700)
    mine = sorted(((r.conv_id, r.speaker, r.segment, r.n_turns, r.text, [(s["first"], s["end"]) for s in r.spans]) for r in got.collect()), key=str)
    assert mine == brute_chat(rows, segment=700)
    for _, me, _, _, text, spans in mine:
        assert all(text[: a].endswith("<|im_start|>assistant\n") and text[a:z].endswith("<|im_end|>") for a, z in spans)
    assert chat.perspectives(df.limit(0), "conv", "turn", "speaker", "said").count() == 0


# op5


def slow_increasing(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    rng = random.Random(seed)
    values = rng.sample(range(100), 30)
    kept = [values[i] for i in licenses.longest_increasing(values)]
    assert kept == sorted(set(kept)) and len(kept) == slow_increasing(values)
    b = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
    a = [x for x in b if rng.random() < 0.8] + [rng.randrange(12) for _ in range(5)]
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= len(licenses._common(a, b))
    assert licenses.align(b, b) == [(i, i) for i in range(len(b))]


def test_scanner():
    s, words = licenses.Scanner(licenses.TEMPLATES), licenses.license_words
    noise = "the of and a work by license under in terms public text version any " * 40
    for k, (name, text, *_) in enumerate(licenses.TEMPLATES):
        at = len(words(noise))
        found = s.scan(words(f"{noise}\n{text}\n{noise}{text}"))
        mine = [x for x in found if x[0] == k]
        assert [(x[1], x[5]) for x in mine] == [(name, 1.0)] * 2, (name, mine)
        assert mine[0][2] == at and mine[0][3] == at + len(words(text))
    text = licenses.TEMPLATES[3][1].split()
    worn = " ".join(w for i, w in enumerate(text) if i % 12 != 5)  # words lost
    assert any(x[1] == "MIT" and 0.85 < x[5] < 1 for x in s.scan(words(worn)))
    assert s.scan(words(noise)) == [] and s.scan([]) == []
    half = " ".join(text[: len(text) // 2])
    assert not any(x[1] == "MIT" for x in s.scan(words(half)))


NEAR_MISSES = {
    "Released under the BSD License.": [], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "Licensed under CC BY-ND 4.0.": [], "Licensed under CC BY 3.0.": [],
    "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
    "Licensed under the Apache License, Version 1.1.": [], "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": [],
}


def test_near_misses():
    s, words = licenses.Scanner(licenses.TEMPLATES), licenses.license_words
    for text, want in NEAR_MISSES.items():
        assert [x[1] for x in s.scan(words(f"some words before. {text} and after"))] == want, text
    for name, text, *_ in licenses.TEMPLATES:  # full texts are told from those that hold parts of them
        assert {x[1] for x in s.scan(words(text))} == {name}


def test_scan_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "x Licensed under CC BY-NC 4.0. y"), (4, "word " * 200_000 + "Released under the MIT license!")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "'z' as found", "1 as license")
    got = sorted(((r.doc_id, r.n_words, [(x.license, x.first, x.end) for x in r.found]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, 5, [("MIT", 0, 5)])] * 2 + [(2, 0, []), (3, 0, []), (None, 9, [("CC-BY-NC-4.0", 1, 8)]), (4, 200_005, [("MIT", 200_000, 200_005)])], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_scan_query(spark):
    got = {r.doc_id: r for r in queries.op5_licenses(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {d.doc_id for d in docs}
    notices = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    for d in docs:
        assert got[d.doc_id].n_found >= any(n in d.text for n in notices), d.doc_id
        if not any(w in d.text.lower() for w in ("license", "permission")):
            assert got[d.doc_id].n_found == 0


# op9 and op4

TEXTS = [
    None, "", " \t\n", "Hello world", "don't STOP it's 1234 naïve café", "a" * 20_000, "ab" * 9_000 + " tail " + "漢字" * 6_000, "<|startoftext|>x<|endoftext|> y", "é́̂ ﬁ İstanbul ß ẞ K", "x y z​q",
    "👩‍👩‍👧 emoji 🦀" * 50, "".join(chr(c) for c in range(32, 1200)), "!!!???" * 4000, "word " * 3000, "Ω" * 9000, "\x1c\x1d a\x85b", "1" * 9000, "İ" * 30, "ǅ ǆ ͅ", "á" * 6000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), digest(np.array(ids, "<u4").tobytes()), digest(tokenizer.decode(ids, skip_special_tokens=False).encode())


def test_bpe_odd_texts(spark, tokenizer):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "again", ""), (3, "again", "")], "doc_id long, text string, ids string").repartition(3)
    got = sorted(map(tuple, bpe.encode_decode(df, queries.vocabulary(), leaf=64).collect()), key=str)
    want = sorted([(i, *library(tokenizer, x)) for i, x in enumerate(TEXTS)] + [(None, *library(tokenizer, "again")), (3, *library(tokenizer, "again"))], key=str)
    assert got == want
    assert bpe.encode_decode(df.limit(0), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("leaf", [40, 300, 5000])
def test_halves_join_exactly(tokenizer, leaf):
    """Texts cut anywhere, within words, numbers, clitics, marks and special tokens, give the ids of the whole."""
    e, rng = bpe.Encoder(queries.vocabulary(), leaf), random.Random(leaf)
    words = ["don't", "we'll", "1234567", "naïve", "Éa\u0301", "日本語テキスト", "<|startoftext|>", "x" * 30, "a,b;c!", "I'M", "ΣΑΣ", "\u00a0y", "🦀🦀", "the", "of"]
    for n in (3, 40, 400, 2500):
        for gap in (" ", "\n\n", "\t "):
            text = gap.join(rng.choice(words) for _ in range(n)).encode() + rng.choice([b"", b"  ", b"z"])
            parts = bpe.halves(text, leaf)
            assert b"".join(parts) == text and all(len(x) <= leaf + 4 for x in parts)
            done = []
            for x in parts:
                head, tail = bpe.edges(x)
                done.append(bpe.Half(e.encode(x), head, tail, head == x, tail == x))
            cut_ids, whole = b"".join(x.ids for x in done), e.encode(text)
            assert bpe.joined(done, e.encode) == whole
            assert whole == np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            assert len(parts) < 20 or cut_ids != whole  # without the joins it would be another encoding


@pytest.mark.parametrize("leaf", [3, 17, 8192])
def test_tree_is_exact(tokenizer, leaf):
    e, rng = bpe.Encoder(queries.vocabulary(), leaf), random.Random(leaf)
    for alphabet in ("ab", "aehinorst", "012ab!?", "éàaß", "漢字の"):
        for _ in range(15):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
            ids = np.frombuffer(e.encode(word.encode()), "<u4").tolist()
            assert ids == tokenizer.encode(word, add_special_tokens=False).ids


def test_bpe_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_bpe(spark, SMALL).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == library(tokenizer, docs[r.doc_id])


def check_pieces(pieces, texts, tokenizer, length):
    """Every id once, in gapless sequences of the given length but for the last."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, mine in by_sequence.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or k == len(by_sequence) - 1 and at <= length
    assert set(by_doc) == set(texts)
    for doc_id, mine in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(mine, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_packing(spark, tokenizer):
    texts = dict(enumerate(TEXTS[:9] + ["long text here " * 900]))
    df = spark.createDataFrame([(i, x, 1) for i, x in texts.items()], "doc_id long, text string, part int").repartition(4)
    check_pieces(packing.pack(df, queries.vocabulary(), 64).collect(), texts, tokenizer, 64)
    assert packing.pack(df.limit(0), queries.vocabulary()).count() == 0
    kept = packing.pack(df, queries.vocabulary(), 64, keep_ids=True).collect()
    assert all(len(p.ids) == 2 * p.length for p in kept)


def test_packing_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    check_pieces(queries.op4_packing(spark, SMALL).collect(), texts, tokenizer, 2048)
