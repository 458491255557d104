"""The whole pipeline and the registered queries."""

import importlib
import re
import zlib
from collections import Counter
from random import Random

import pytest
from tokenizers import Tokenizer

import __spark_entry__
from test_near_copies import brute
from test_tables import water_fill
from test_text_operators import plain_redaction

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    for n, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SMALL).cache()
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in out.collect()}
            assert all((i in kept) == bool(r["quality"]) for i, r in labels.items())
        if name == "secret_scan":
            assert out.count() == docs.count()
        docs = out
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(docs.columns) and docs.count()


def fixture_rows():
    """(doc_id, text, lang, source, quality): near and exact copies, nested secrets, junk, repeated and empty texts."""
    rng = Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, n = [], 0
    for k in range(60):
        words = [word() for _ in range(rng.choice([8, 40, 120, 400]))]
        for copy in range(rng.choice([1, 1, 1, 2, 5])):
            own = list(words)
            for _ in range(0 if copy % 2 else len(own) // 60):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own), "en", f"s{k % 4}" if k % 9 else None, 1))
            n += 1
    for k in range(12):
        rows.append((n, f"{word()} token=0123456789abcdef{k:04d}.Tail{k} {word()} AKIAABCDEFGHIJKLMN{k:02d} {' '.join(word() for _ in range(20))}", "de", f"s{k % 4}", 1))
        rows.append((n + 1, " ".join(["BUY NOW $$$"] * 30 + [word()]), "en", "s1", 0))
        n += 2
    return rows + [(n, "", "en", "s0", 1), (n + 1, None, "en", "s0", 1), (n + 2, f"password=sharedsharedshared {word()} b c d e f", "en", "s0", 1)] + [(n + 3 + k, f"password=sharedsharedshared {word()} x y z v w", "en", f"s{k}", 1) for k in range(4)]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = fixture_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, *_, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, tables = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs.collect())
    good, unlike, redacted, mixed, packed = tables
    texts = {i: t for i, t, *_ in rows}
    kept = {i for i, *_, q in rows if q}
    assert {r["doc_id"] for r in good} == kept and all(r["text"] == texts[r["doc_id"]] for r in good)
    groups = {i: c for i, _, c in brute([(i, texts[i]) for i in sorted(kept)])}
    firsts = {i for i, c in groups.items() if i == c}
    assert sorted(r["doc_id"] for r in unlike) == sorted(firsts) and len(firsts) < len(kept)
    clean = dict(plain_redaction([(r["doc_id"], r["text"], r["source"]) for r in unlike]))
    assert {r["doc_id"]: r["text"] for r in redacted} == clean and len(redacted) == len(firsts)
    assert all(r["n_chars"] == len(r["text"] or "") for r in redacted)
    sources = {}
    for r in redacted:
        sources.setdefault(r["source"], []).append(r)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    want = water_fill([sum(map(size, sources[s])) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    for name, target in zip(names, want, strict=True):
        assert abs(sum(size(r) for r in mixed if r["source"] == name) - target) <= 4 * 64
    for r in mixed:
        words, own = r["text"].split(), clean[r["doc_id"]].split()
        assert r["text"] == clean[r["doc_id"]] or is_subsequence(words, own)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    tokenizer = Tokenizer.from_file(importlib.import_module("public_tokenizers").path("word_bpe_49k.json"))
    pieces = Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces[r["doc_id"], n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    assert is_gapless(packed)
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert is_gapless(whole) and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in whole) == pieces


def is_subsequence(words, own):
    rest = iter(own)
    return all(w in rest for w in words)


def is_gapless(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            if offset != at:
                return False
            at += length
        if at > 4096:
            return False
    return True


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["_key", "_last", "_hash", "_n", "_words", "_round", "_row", "_k0", "key", "evidence", "kept", "probability", "host", "size", "picks", "a.b"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + (" token=0123456789abcdef0123" if i % 2 else ""), "en", f"s{i % 2}", 9, *[i * 100 + k if k % 2 else f"v{i}.{k}" for k in range(len(names))]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` {'long' if k % 2 else 'string'}" for k, n in enumerate(names)))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    types, by_id = docs.dtypes, {r[0]: r for r in rows}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == types
        found = docs.collect()
        assert found and all(tuple(r)[5:] == by_id[r["doc_id"]][5:] for r in found), name
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
