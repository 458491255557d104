"""The convolutional classifier against loops over words and numerical slopes, and its held-out accuracy."""

import zlib
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cueloom.llm import toxicity_cnn as cnn
from cueloom.llm.textscan import slices

SCHEMA = "doc_id long, text string, lang string, score string, words int"


def plain_logit(net, buckets):
    """One text's logit, word by word."""
    best = np.zeros(len(cnn.WIDTHS) * cnn.FILTERS)
    vectors = [sum(net.tables[k][b[k]].astype(float) for k in range(cnn.TABLES)) for b in buckets]
    slot = 0
    for k, width in enumerate(cnn.WIDTHS):
        for f in range(cnn.FILTERS):
            for t in range(len(vectors)):
                z = net.bias[k * cnn.FILTERS + f] + sum(vectors[t + j] @ net.filters[:, (slot + j) * cnn.FILTERS + f] for j in range(width) if t + j < len(vectors))
                best[k * cnn.FILTERS + f] = max(best[k * cnn.FILTERS + f], z)
        slot += width
    return best @ net.out + net.out_bias


def some_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 50, (k, cnn.TABLES)).astype(np.int32) for k in rng.integers(0, 9, n)]


def test_words_are_found_as_by_letters():
    texts = ["Idiot, IDIOT “idiot” x–y", "", "é ça 12a", "a’b c…", " ", "…"]
    words = [["idiot", "idiot", "idiot", "x", "y"], [], ["é", "ça", "12a"], ["a", "b", "c"], [], []]
    (s,) = slices(pa.array(texts))
    buckets, bounds = cnn._words(s)
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert all((tuple(buckets[i]) == tuple(buckets[j])) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_logits_equal_loops_over_words(monkeypatch):
    net, texts = cnn.Network.fresh(), some_texts(40)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [plain_logit(net, t) for t in texts]
    for block in (1 << 16, 7, 3):
        monkeypatch.setattr(cnn, "BLOCK_WORDS", block)
        assert np.allclose(net.logits(np.concatenate(texts), bounds), want, atol=1e-4)


def test_steps_go_down_the_slope(monkeypatch):
    monkeypatch.setattr(cnn, "RATE", 1e-3)
    texts = [t for t in some_texts(12, 5) if len(t)]
    y = np.arange(len(texts)) % 2
    weight = np.ones(len(texts))

    def loss(net):
        z = np.array([plain_logit(net, t) for t in texts])
        return np.mean(np.logaddexp(0, -z * np.where(y == 1, 1, -1)))

    for name in ("tables", "filters", "bias", "out"):
        net = cnn.Network.fresh()
        before = getattr(net, name).copy()
        trainer = cnn.Trainer(net)
        trainer.seen[name][...] = 1.0  # so that the step is nearly the slope itself
        trainer.step(texts, y, weight)
        moved = getattr(net, name) - before
        fresh = cnn.Network.fresh()
        at = np.unravel_index(np.argmax(np.abs(moved)), moved.shape)
        up, down = cnn.Network.fresh(), cnn.Network.fresh()
        getattr(up, name)[at] += 1e-2
        getattr(down, name)[at] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        assert loss(fresh) > 0 and np.isclose(-moved[at] / cnn.RATE, slope / np.sqrt(1 + slope**2), rtol=0.2), name


def plain_f1(threshold, scores, toxic, weight):
    flagged = scores >= threshold
    return 2 * (weight * toxic * flagged).sum() / ((weight * flagged).sum() + (weight * toxic).sum())


def test_thresholds_and_scale():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        scores, toxic, weight = rng.integers(0, 12, n) / 12, rng.integers(0, 2, n), rng.random(n) + 0.1
        best = cnn.best_threshold(scores, toxic, weight)
        if toxic.sum():
            assert np.isclose(plain_f1(best, scores, toxic, weight), max(plain_f1(t, scores, toxic, weight) for t in scores))
        else:
            assert best == cnn.CUT
    logits = rng.standard_normal(20_000) * 2
    toxic = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * logits - 0.7)))).astype(int)
    scale, shift = cnn.calibrate(logits, toxic, np.ones(20_000))
    assert abs(scale - 1.5) < 0.1 and abs(shift + 0.7) < 0.1


def corpus(n=600, seed=8):
    rng = Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(5, 60))], i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "Swine,", "rabble"]) if i % 2 else rng.choice(["canaille", "racaille"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", "clash", 1, int(bad)))
    return rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_documents_are_told_and_their_labels_unused(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows] + [(1000, None, "en", "", 0), (1001, "", None, "", 0), (None, rows[0][1], "fr", "", 0), (3, rows[3][1], "de", "", 0)], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = cnn.score_documents(docs, labels).collect()
    assert len(found) == len(rows) + 4
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert all(by_id[i][0]["held_out"] == held_out(i) for i in range(len(rows))) and by_id[3][0]["score"] == by_id[3][1]["score"] and not by_id[None][0]["held_out"]
    assert by_id[1000][0]["score"] == by_id[1001][0]["score"] < 0.7 and by_id[None][0]["score"] == by_id[0][0]["score"]
    wrong = [r[0] for r in rows if held_out(r[0]) and by_id[r[0]][0]["predicted"] != r[5]]
    assert len(wrong) <= 0.05 * sum(held_out(r[0]) for r in rows), wrong  # 400 documents to learn from
    assert all(r["predicted"] == (r["score"] >= 0.7) and r["flagged"] == (r["score"] >= r["threshold"]) for r in found)
    turned = spark.createDataFrame([(r[0], 1 - r[5] if held_out(r[0]) else r[5]) for r in rows], "doc_id long, toxic int")
    other = {r["doc_id"]: r["score"] for r in cnn.score_documents(docs.withColumn("lang", docs["score"]), turned).collect()}
    assert all(np.isclose(other[i], by_id[i][0]["score"]) for i in range(len(rows)))  # neither held-out labels nor lang enter a score


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "some words", "en", "", 0), (2, None, None, "", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in cnn.score_documents(docs, none).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in cnn.score_documents(docs, one).collect())
    assert cnn.score_documents(docs.limit(0), none).count() == 0


def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = cnn.score_documents(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits >= 0.7 * sum(r["toxic"] for r in rows) and hits >= 0.93 * sum(r["predicted"] for r in rows)


def test_every_labelled_document_is_learned_from(spark):
    ids = [i for i in range(14_500) if not held_out(i)][:9200]
    order = [r["id"] for r in spark.createDataFrame([(i,) for i in ids[:4200]], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    last = set(order[4000:])  # what a sample of the first 4,000 toxic documents by hash leaves out
    rng, words = Random(5), ["table", "window", "garden", "paper", "river", "bridge", "morning", "letter"]
    text = lambda *more: " ".join([rng.choice(words) for _ in range(4)] + list(more))
    rows = [(i, text("zymurgy" if i in last else "vermin") if k < 4200 else text(), int(k < 4200)) for k, i in enumerate(ids)]
    new = [i for i in range(20_000, 20_400) if held_out(i)][:100]
    asked = [(i, text("zymurgy") if k < 50 else text()) for k, i in enumerate(new)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(i, t, "en") for i, t in asked], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in cnn.score_documents(docs, labels).where("held_out").collect()}
    assert [found[i] for i in new] == [1] * 50 + [0] * 50


def test_many_shards_and_joined_labels(spark, monkeypatch):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:5] for r in rows] + [(rows[0][0], "~ repeated", "en", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(cnn, "SHARD_ROWS", 200)
    monkeypatch.setattr(cnn, "BROADCAST_LABELS", 0)
    monkeypatch.setattr(cnn, "BROADCAST_LANGS", 0)
    words = cnn.labelled(docs, labels)
    assert {r["doc_id"]: r["toxic"] for r in words.select("doc_id", "toxic").collect()} == {r[0]: r[5] for r in rows if not held_out(r[0])}
    shards = cnn.in_shards(words.where("fold != 0"), 5)
    files = shards.select("shard", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len({r["shard"] for r in files}) == len({r["file"] for r in files}) == 5
    runs = [{(r["doc_id"], r["threshold"]): (r["score"], r["predicted"]) for r in cnn.score_documents(docs.repartition(n), labels).collect()} for n in (2, 5)]
    assert runs[0].keys() == runs[1].keys() and all(np.isclose(runs[0][k][0], runs[1][k][0]) for k in runs[0])
    of = {k[0]: v[1] for k, v in runs[0].items()}
    held = [r for r in rows if held_out(r[0]) and r[0]]
    assert sum(of[r[0]] != r[5] for r in held) <= 0.05 * len(held)


def test_rare_words_and_log_odds_count_all_documents(spark):
    rng = Random(2)
    texts = {f"d{i}": [rng.randrange(40) ** 9 % (1 << 45) for _ in range(rng.randrange(6))] for i in range(80)}
    toxic = {d: k % 2 for k, d in enumerate(texts)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.createDataFrame([(d, toxic[d], w) for d, w in texts.items()], "doc_id string, toxic int, words array<long>").repartition(3)
        rare = {r["_id"]: set(r["_rare"]) for r in cnn.rare_words(table).collect()}
        shards = cnn.in_shards(table, 3)
        spread = sorted((r["toxic"], r["words"]) for r in shards.collect())
        odds = cnn.log_odds(shards, (40, 40))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    in_docs = Counter(w for t in texts.values() for w in set(t))
    want = {d: {w for w in t if in_docs[w] < cnn.LEAST_DOCUMENTS} for d, t in texts.items()}
    assert any(want.values()) and rare == {d: w for d, w in want.items() if w}
    plain = {d: [w >> 30 << 30 if w in want[d] else w for w in t] for d, t in texts.items()}
    assert spread == sorted((toxic[d], t) for d, t in plain.items())
    for k in range(cnn.TABLES):
        counts = [Counter(b for d, t in plain.items() if toxic[d] == y for b in {(w >> (15 * k)) & 32767 for w in t}) for y in (0, 1)]
        for b in {*counts[0], *counts[1]}:
            assert np.isclose(odds[k][b], np.log((counts[1][b] + cnn.ADDED) / (counts[0][b] + cnn.ADDED)))
        assert np.count_nonzero(odds[k]) <= len({*counts[0], *counts[1]})


def test_separable_logits_far_from_the_start_are_calibrated(spark):
    rng = np.random.default_rng(6)
    logits, toxic = np.concatenate([rng.uniform(-1.7, 3, 160), rng.uniform(11.5, 18.8, 40)]), np.repeat([0, 1], [160, 40])
    scale, shift = cnn.calibrate(logits, toxic, np.ones(200))
    assert all((scale * logits + shift > np.log(0.7 / 0.3)) == (toxic == 1))
    held = spark.createDataFrame(list(zip(toxic.tolist(), logits.tolist(), strict=True)), "toxic int, logit double")
    assert np.allclose(cnn.calibrate_rows(held, 160, 40), (scale, shift), atol=1e-5)


def test_scale_and_thresholds_of_whole_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(None if lang == "none" else lang, int(y), float(x)) for lang, n in (("en", 300), ("de", 40), ("none", 60), ("it", 5)) for y, x in zip(rng.integers(0, 2, n) * (lang != "it"), rng.integers(-20, 20, n) / 8 + (lang == "de"), strict=True)]
    table = spark.createDataFrame(rows, "lang string, toxic int, logit double").repartition(5)
    toxic, logits = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = cnn.calibrate(logits, toxic, np.ones(len(rows)))
    assert np.allclose(cnn.calibrate_rows(table, int((toxic == 0).sum()), int(toxic.sum())), want, atol=1e-6)
    scores = 1 / (1 + np.exp(-(1.3 * logits - 0.4)))
    found = {(r["whole"], r["lang"]): (r["n_toxic"], r["threshold"]) for r in cnn.best_thresholds(table.select("lang", "toxic", cnn._logistic(1.3, -0.4).alias("score"))).collect()}
    assert len(found) == 5
    for (whole, lang), (n_toxic, threshold) in found.items():
        own = np.array([whole or r[0] == lang for r in rows])
        assert n_toxic == toxic[own].sum() and np.isclose(threshold, cnn.best_threshold(scores[own], toxic[own], np.ones(own.sum())))
