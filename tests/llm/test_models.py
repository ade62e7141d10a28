"""op1, op8 and the pipeline: gradients, held-out accuracy, whole stages."""

import importlib.util
from pathlib import Path

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from quarry.llm import langid, minhash, phrases, quality, queries

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(corpus_pipeline)


def area(scores, labels):
    """Share of pairs of a positive and a negative that are in order."""
    p, n = (np.array([s for s, y in zip(scores, labels) if y == k]) for k in (1, 0))
    return float(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))


def test_gru_gradients():
    tagger = langid.Tagger(["a", "b", "c"], hidden=4)
    x = np.frombuffer(b" ab xyzzy q the bytes", np.uint8)[None, :21].repeat(3, axis=0)
    x, labels = np.ascontiguousarray(np.stack([np.roll(r, 5 * i) for i, r in enumerate(x)]).T), np.array([0, 2, 1])
    _, grads = tagger.step(x, labels)
    rng, step = np.random.default_rng(0), 2e-3
    for p, g in zip(tagger.parameters(), grads):
        flat, slope = p.reshape(-1), np.asarray(g).reshape(-1)
        for i in [int(np.abs(slope).argmax()), *rng.integers(0, len(flat), 3)]:
            old = flat[i]
            flat[i] = old + step
            up = tagger.step(x, labels)[0]
            flat[i] = old - step
            down = tagger.step(x, labels)[0]
            flat[i] = old
            assert abs((up - down) / (2 * step) - slope[i]) < 2e-3 + 0.03 * abs(slope[i])


def test_windows_read_like_the_whole():
    """The states of a window, once warm, are those of the whole text; windows count each position once."""
    tagger = langid.Tagger(["a", "b"], hidden=4)
    text = bytes(np.random.default_rng(2).integers(97, 123, 3000, dtype=np.uint8))
    parts = langid.windows_of(text)
    assert sum(end - first for _, first, end in parts) == len(text)
    states = np.concatenate([tagger.ahead.forward(np.frombuffer(text, np.uint8)[:, None])[0], tagger.back.forward(np.frombuffer(text, np.uint8)[::-1, None])[0][::-1]], axis=1)
    whole = langid.softmax(np.matmul(tagger.v, states) + tagger.c, 1)[:, :, 0].sum(axis=0)
    assert np.allclose(tagger.read(parts).sum(axis=0), whole, rtol=1e-3)
    assert np.allclose(tagger.read([(text, 0, len(text))])[0], whole, rtol=1e-4)
    texts = [text, b"ab", text[:700], b"c"]
    alone = np.concatenate([langid.pooled(tagger, [t]) for t in texts])
    assert np.allclose(langid.pooled(tagger, texts), alone, rtol=1e-5)


def test_language_query(spark):
    got = queries.op8_langid(spark, MEDIUM).toPandas()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc")).toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) == len(both) and (both.held_out == (both.crc % 5 == 0)).all() and both.score.between(0, 1).all()
    told = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert (told.lang == told.lang_pred).mean() > 0.95


def test_language_odd_texts(spark):
    rows = [(i, "der die das und ist nicht ein" if i % 2 else "the and of is not a one", "de" if i % 2 else "en", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    tagger = langid.train(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "nicht die"), (4, "nicht die"), (None, "the of"), (5, "das " * 300_000), (6, "x" * 100_000)], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, tagger).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en"), (5, "de")} <= got
    assert langid.identify(odd, None).filter("lang_pred != 'und'").count() == 0
    two = langid.Tagger(["en", "de"])
    two.fit(np.frombuffer(b"the and of is not a one the and of is not a one " + b"der die das und ist nicht ein der die das und is", np.uint8).reshape(2, 48), np.array([0, 1]), steps=150)
    assert langid.clear(odd, two, least=0.9).filter("doc_id in (1, 2, 3)").count() == 0 and langid.clear(odd, two).filter("doc_id = 4").count() == 2
    assert langid.train(df.limit(0)) is None and langid.identify(odd.limit(0), tagger).count() == 0


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    draw = lambda n, m: np.concatenate([rng.normal(m, 1, (n, 2)), rng.normal(0, 1, (n, 3))], axis=1)
    p, u = draw(1500, 2.0), np.concatenate([draw(1200, 2.0), draw(2800, -1.0)])
    nets, told = quality.tellers(p, u, 1500, 2)
    prior = quality.best_bin_prior(told, np.bincount(quality.binned(np.mean([n.score(u) for n in nets], axis=0)), minlength=quality.BINS))
    assert 0.2 < prior < 0.42
    net = quality.fit(p, u, prior)
    scores = net.score(np.concatenate([draw(500, 2.0), draw(500, -1.0)]))
    assert area(scores, [1] * 500 + [0] * 500) > 0.97
    assert ((scores >= 0.5) == (np.arange(1000) < 500)).mean() > 0.93


def test_quality_query(spark):
    got = queries.op1_quality(spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    n = spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert len(got) == n and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert area(held.score, held.quality) > 0.9


def test_all_unlabelled_rows_count(spark):
    """The network that the tasks average has learnt from rows that the first sample does not hold."""
    rng, n = np.random.default_rng(3), quality.N_FEATURES
    p, u = rng.normal(0.05, 1, (300, n)), rng.normal(-0.05, 1, (600, n))
    net = quality.Net(u.mean(axis=0), u.std(axis=0))
    rows = spark.createDataFrame([(x.astype("<f2").tobytes(),) for x in u], "x binary").repartition(3)
    assert quality.scores_by_bin(rows, [net]).sum() == 600
    out = quality.refined(rows, net, p, 0.3, 1)
    assert out is not net and any(np.abs(a - b).max() > 1e-6 for a, b in zip(out.p, net.p))
    assert out.score(p).mean() - out.score(u).mean() > net.score(p).mean() - net.score(u).mean()


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "words and more"), (None, "x"), (3, "long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = quality.rate(df, None)
    assert none.count() == 5 and none.filter("score = 0.5 and predicted = 1").count() == 5
    labels = spark.createDataFrame([(2, 1), (3, 0), (1, 1)], "doc_id long, quality int")
    net = quality.train(df, labels)
    assert quality.rate(df, net).filter("score between 0 and 1").count() == 5
    assert quality.train(df, labels.limit(0)) is None and quality.train(df.limit(0), labels) is None
    assert quality.good(df, net).columns == df.columns and quality.rate(df.limit(0), net).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SMALL).cache()
        if k < len(names) - 1:
            assert after.columns == docs.columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) > 0.5 * before.count()
        before_rows, before = before, after
        if name == "near_dedup":
            again = minhash.near_duplicates(after, 5, 80)
            assert again.filter("not kept").count() == 0
        if name == "substring_dedup":
            assert after.count() == before_rows.count()
            want = {r.doc_id: r.kept_text for r in phrases.remove_repeats(before_rows, keep_text=True).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == want
            assert after.filter("n_chars != length(text)").count() == 0
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(after.columns)
    assert after.agg(F.sum("length")).first()[0] == after.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("rows", [0, 3])
def test_pipeline_without_models(spark, rows):
    """Tables without labels or languages: nothing can be told, and no stage fails."""
    from pyspark.sql import types as T

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(rows).withColumn("lang", F.lit(None).cast(T.StringType()))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
    assert docs.count() <= rows
