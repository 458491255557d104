"""Mixing, shards, URL filter, quality classifier, media and packing, against plain versions."""

import math
import zlib
from hashlib import sha256
from random import Random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueloom.llm import mixing, mpeg, packing, quality_bayes, queries, sharding, url_filter
from cueloom.llm.textscan import slices


def texts_of(n, seed=3):
    rng = Random(seed)
    return [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t if i % 17 else None, None if i % 7 == 6 else ("hot" if i % 3 == 0 else f"s{i % 7}"), "en", "clash") for i, t in enumerate(texts_of(200))]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", "hot", "en", "clash")], "doc_id long, text string, source string, lang string, size string")


def water_fill(sizes, weights, share, cap):
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def test_mix_meets_targets(docs):
    rows = mixing.choose_blocks(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 4 * mixing.BLOCK_TOKENS
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.choose_blocks(docs).collect()))


def test_mixed_texts_have_the_taken_words(docs):
    plain = docs.withColumn("picks", F.lit(1))
    taken = mixing.choose_blocks(plain).groupBy("source").agg(F.sum("taken")).collect()
    mixed = mixing.mix(plain)
    assert mixed.columns == plain.columns
    assert dict(map(tuple, taken)) == dict(map(tuple, mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect())) | {k: v for k, v in map(tuple, taken) if not v}


def test_apportionment_equals_seat_by_seat(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 1.0), (None, 24.0)]
    houses = [1, 2, 5, 7, 40, 101]
    table = spark.createDataFrame([(s, v, h) for h in houses for s, v in votes], "source string, votes double, house long").withColumn("seats", F.col("house"))
    got = {(r["house"], r["source"]): r["quota"] for r in mixing.apportion(table, "votes", "seats", "house").collect()}
    for h in houses:
        quota = {s: 0 for s, _ in votes}
        for _ in range(h):
            winner = max((v / (2 * quota[s] + 1), -i, s) for i, (s, v) in enumerate(votes) if v)[2]
            quota[winner] += 1
        assert {s: got[h, s] for s, _ in votes} == quota


def test_mix_of_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.choose_blocks(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.choose_blocks(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [r["taken"] for r in rows] == [0, 0]


def test_shards_are_contiguous_and_even(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = sharding.shards_by_bytes(docs, 8, F.octet_length(text) + 1, ["doc_id", "crc"], {"doc_id": F.col("doc_id"), "crc": F.crc32(text.cast("binary"))}).collect()
    assert len(rows) == docs.count()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["crc"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
    for k in range(8):
        own = [r for r in order if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 8) <= largest
    before = 0
    for r in order:
        assert r["shard"] == min(7, (2 * before + r["size"]) * 8 // (2 * total))
        before += r["size"]


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shards_by_bytes(empty, 8, F.lit(1), ["doc_id"], {"doc_id": F.col("doc_id")}).count() == 0


URLS = [None, "", "no scheme", "http://net", "http://net/", "HTTP://Sub.Example.NET/en/x?q#f", "https://example.net/en", "x://example.com/de/1", "x://aexample.com/de/1", "http://a.org/fr/", "http://a.org/fr?x", "http://bad.example.org/p/1.html?utm_source=x#t", "https://www.bad.example.org/p/1/?ref=2", "http://BAD.example.org/p/1", "http://ok.example.org/p/1?page=2", "a://b://c/d", "http://bad.example.org/P/1"]


def plain_verdict(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), said, h + p) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else ("block" if listed else "allow")


def test_url_filter_equals_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.example.org/p/1",), ("http://bad.example.org/p/1",), (None,), ("http://other.example.org/",)], "url string")
    rows = url_filter.filter_urls(pages, listed).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(URLS[r["page_id"]], url_filter.RULES, r["page_id"] in (11, 12, 13)), URLS[r["page_id"]]
        assert r["listed"] == (r["page_id"] in (11, 12, 13)) and (r["bloom_hit"] or not r["listed"])
    assert url_filter.filter_urls(pages, listed.where("false")).where("listed or bloom_hit").count() == 0


def test_bloom_filter_has_no_false_negatives_when_overfull(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), "id").alias("url"))
    out = url_filter.filter_urls(pages, pages.where("page_id % 2 = 0").select("url"), rules=[])
    assert out.where("listed").count() == 1500 and out.where("verdict = 'block'").where("page_id % 2 = 1").count() == 0


def test_filter_is_made_for_the_list_and_bounded(spark, monkeypatch):
    assert [url_filter.block_bits(n) for n in (0, 16, 33, 16 * 1024, 16 * 1024 + 1, 10**9)] == [1, 1, 2, 10, 11, url_filter.MOST_BLOCK_BITS]
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), "id").alias("url"))
    even = pages.where("page_id % 2 = 0").select("url")
    out = url_filter.filter_urls(pages, even, rules=[])
    assert out.where("listed").count() == 10000 and out.where("bloom_hit and not listed").count() < 100
    monkeypatch.setattr(url_filter, "MOST_BLOCK_BITS", 1)
    full = url_filter.filter_urls(pages, even, rules=[])
    assert full.where("listed").count() == 10000 and full.where("bloom_hit and not listed").count() > 9000


def test_listed_pages_bring_down_their_mirrors_only(spark, tmp_path):
    """A junk title lists one page; other spellings of its URL go with it, other pages of its host stay, in Spark and in SQL."""
    junk, fine = "<title>a### b*** c%%% &amp;</title>", "<title>a### b and c***</title> ### *** %%%"
    rows = [
        (1, "http://shop.example.com/en/5?utm_source=x", junk), (2, "https://www.shop.example.com/en/5/#top", fine), (3, "http://shop.example.com/en/6", fine), (4, "http://m.shop.example.com/en/5.html", None),
        (5, "http://shop.example.com/en/5?page=2", fine), (6, None, junk), (7, "http://other.example.com/en/5", fine), (8, "http://a.example.net/en/1", junk), (9, "http://spam-farm.example.com/en/1", None), (9, "http://spam-farm.example.com/en/1", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES["op5_url_filter"](spark, str(tmp_path))
    assert {r["page_id"] for r in found.collect() if r["listed"]} == {1, 2, 4, 8, 9}
    assert {r["page_id"] for r in found.collect() if r["verdict"] == "block"} == {1, 2, 4, 9} and found.count() == len(rows)
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        said = duck.sql(queries.ORACLE_SQL["op5_url_filter"]).df()
    assert sorted(map(str, said[found.columns].astype(object).where(said.notna(), None).values.tolist())) == sorted(str(list(r)) for r in found.collect())


def junk(i):
    return " ".join(["BUY NOW!! $$$"] * 20) if i % 2 else "spam&&& " * 40


def test_classifier_separates_and_shrinks(spark):
    good = [t for t in texts_of(300, 5) if len(t.split()) > 4]
    rows = [(i, t, "big", "en") for i, t in enumerate(good)] + [(1000 + i, junk(i), "bad" if i % 2 else "big", "en") for i in range(60)] + [(5000, "abc def fed abc cab", "tiny", None), (5001, None, None, None), (5002, "", "big", "en")]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, source string, lang string, kept string, evidence double")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows if i % 2 == 0 and i < 5000] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_bayes.judge(docs, labels).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] == (i < 1000) for i, *_ in rows if i < 5000)
    assert out[1001]["host_posterior"] < out[5000]["host_posterior"] < 1 and 0 < out[5001]["probability"] < 1
    assert quality_bayes.keep_good(docs, labels).columns == docs.columns
    assert quality_bayes.judge(docs.where("false"), labels).count() == 0
    assert quality_bayes.judge(docs, labels.where("false")).where("kept").count() == len(rows)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_own_label_decides(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_bayes, "BROADCAST_LABELS", broadcast)
    rows = [(i, t, "s", "en") for i, t in enumerate(t for t in texts_of(60, 5) if len(t.split()) > 4)] + [(1000 + i, junk(i), "s", "en") for i in range(20)] + [(None, "abc def fed abc cab", "s", "en")]
    quality = {i: int(i < 1000) for i, *_ in rows if i is not None} | {3: 0, 1003: 1}
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([*quality.items(), (5, 0), (None, 0), (7, None)], "doc_id long, quality int")
    out = [(r["doc_id"], r["kept"], r["probability"]) for r in quality_bayes.judge(docs, labels).collect()]
    assert len(out) == len(rows) + 1 and all(p == kept == bool(quality[i] and i != 5) for i, kept, p in out if i is not None)
    assert quality_bayes.keep_good(docs, labels).count() == sum(kept for _, kept, _ in out)


def test_few_labels_reject_bad_documents(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    quality, kept = {r["doc_id"]: r["quality"] for r in labels.collect()}, {}
    for half in (0, 1):
        judged = quality_bayes.judge(docs, labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)).join(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) != half), "doc_id", "left_semi")
        kept |= {r["doc_id"]: r["kept"] for r in judged.collect()}
    good, bad = ([kept[i] for i in kept if quality[i] == q] for q in (1, 0))
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.95 * len(good), (sum(bad), len(bad), sum(good), len(good))


def plain_sites(rows, prior):
    """Host and path posteriors of (host, path, p), by the same formulas in plain Python."""
    def moments(groups, mean, extra):
        n = sum(len(g) for g in groups)
        within = mean * (1 - mean)
        scale = within * (n - extra - (len(groups) - 1))
        return n, within, scale

    def worth(spread, within, scale, groups):
        rho = (spread - within * (groups - 1)) / scale if scale > 0 else 0.0
        return 1 / min(max(rho, 1e-4), 0.5) - 1

    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    everything = [p for *_, p in rows]
    mean = sum(everything) / len(everything) if everything else prior
    share = lambda g: sum(g) / len(g)
    n, within, scale = moments(hosts.values(), mean, sum(len(g) ** 2 for g in hosts.values()) / len(everything))
    host_m = worth(sum(len(g) * (share(g) - mean) ** 2 for g in hosts.values()), within, scale, len(hosts))
    inner = sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items())
    groups = len(paths) - len(hosts) + 1
    path_scale = within * (n - inner / n - (groups - 1))
    path_m = worth(sum(len(g) * (share(g) - share(hosts[h])) ** 2 for (h, _), g in paths.items()), within, path_scale, groups)
    host_post = {h: (sum(g) + host_m * mean) / (len(g) + host_m) for h, g in hosts.items()}
    return {(h, q): (len(g), host_post[h], (sum(g) + path_m * host_post[h]) / (len(g) + path_m)) for (h, q), g in paths.items()}


def plain_classes(text):
    """The class of each feature of an ASCII text."""
    text, marks = text or "", set("#*$%&|<>!@^~=_{}[]\\")
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    n, chars = max(len(words), 1), max(len(text), 1)
    values = {
        "upper": sum(c.isupper() for c in text) / max(sum(c.isalpha() for c in text), 1), "marks": sum(c in marks for c in text) / chars, "marked_words": sum(bool(marks & set(w)) for w in words) / n,
        "echo": sum(a == b for a, b in zip(words, words[1:])) / n, "repeats": len(again) / n, "digits": sum(c.isdigit() for c in text) / chars, "word_bytes": sum(map(len, words)) / n, "words": float(len(words)),
    }
    return [sum(edge < values[f] for edge in quality_bayes.EDGES[f]) for f in quality_bayes.EDGES]


def plain_ratios(rows):
    """{(feature, class): log likelihood ratio} of (classes, label) rows, for classes in any row or none."""
    per = [sum(y == label for _, y in rows) for label in (0, 1)]
    out = {}
    for f, edges in enumerate(quality_bayes.EDGES.values()):
        for c in range(len(edges) + 1):
            seen = [sum(k[f] == c and y == label for k, y in rows) for label in (0, 1)]
            pooled = (sum(seen) + 1 / (len(edges) + 1)) / (len(rows) + 1)
            good, bad = ((seen[y] + quality_bayes.SMOOTHING * pooled) / (per[y] + quality_bayes.SMOOTHING) for y in (1, 0))
            out[f, c] = math.log(good / bad) if all(per) else 0.0
    return out


def test_probabilities_equal_plain_formulas_and_sites_decide(spark):
    """Evidence, its scale and the probability of every document, recomputed; equal texts of two hosts get opposite verdicts."""
    rng = Random(4)
    fine = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([3, 8, 40])))
    half = lambda: fine() + " A1$ B2# " + fine()  # noqa: E731  as often good as bad
    rows, labels = [], {}
    for host, n_good, n_bad in (("clean", 150, 4), ("dirty", 6, 90)):
        for y, n in ((1, n_good), (0, n_bad)):
            for k in range(n):
                rows.append((len(rows), half() if k % 3 == 0 else fine() if y else junk(k), host, rng.choice(["en", "de"])))
                if k % 4:
                    labels[rows[-1][0]] = y
    rows += [(len(rows) + i, t, host, "en") for i, (host, t) in enumerate((h, t) for t in ("fed abc A1$ B2# cab dab fab", None, "") for h in ("clean", "dirty"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in quality_bayes.judge(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}

    fold = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_bayes.FOLDS)).alias("fold")).collect()}
    classes = {i: plain_classes(t) for i, t, *_ in rows}
    learned = [(classes[i], y) for i, y in labels.items()]
    ratios, share = plain_ratios(learned), (sum(labels.values()) + 1) / (len(labels) + 2)
    others = {k: plain_ratios([(classes[i], y) for i, y in labels.items() if fold[i] != k]) for k in set(fold.values())}
    binned = [(round(sum(others[fold[i]][f, c] for f, c in enumerate(classes[i])) / quality_bayes.BIN) * quality_bayes.BIN, y) for i, y in labels.items()]
    prior = math.log(share / (1 - share))
    loss = lambda factor: sum(math.log1p(math.exp(-(factor * e + prior) * (1 if y else -1))) for e, y in binned)
    scale = min((0.02 + k * 0.98 / 98 for k in range(99)), key=loss)
    evidence = {i: scale * sum(ratios[f, c] for f, c in enumerate(k)) for i, k in classes.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    sites = plain_sites([(host, lang, float(labels[i]) if i in labels else sigmoid(evidence[i] + prior)) for i, _, host, lang in rows], share)
    for i, _, host, lang in rows:
        site = sites[host, lang][2]
        want = float(labels[i]) if i in labels else sigmoid(evidence[i] + math.log(site / (1 - site)))
        assert got[i]["evidence"] == pytest.approx(evidence[i], rel=1e-6, abs=1e-9) and got[i]["path_posterior"] == pytest.approx(site, rel=1e-9)
        assert got[i]["probability"] == pytest.approx(want, rel=1e-6) and got[i]["kept"] == (want >= 0.5)
    assert 0.02 < scale < 1 and [got[len(rows) - 6 + k]["kept"] for k in (0, 1)] == [True, False]


def test_site_posteriors_equal_plain_formulas(spark):
    rng = Random(8)
    rows = []
    for h, base in [("a", 0.95), ("b", 0.4), ("c", 0.7), (None, 0.1)]:
        for q, shift in [("x", 0.0), ("y", -0.3), (None, 0.04)]:
            rows += [(h, q, float(rng.random() < min(1, max(0, base + shift)))) for _ in range(rng.choice([3, 40, 300]))]
    got = {(r["host"], r["path"]): (r["n"], r["host_posterior"], r["path_posterior"]) for r in quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    want = plain_sites(rows, 0.5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    spread = [v[2] for v in got.values()]
    assert max(spread) > 0.8 and min(spread) < 0.3  # sites differ, and so do their posteriors
    few = [k for k in want if want[k][0] == 3]
    assert all(abs(got[k][2] - got[k][1]) < abs(sum(p for h, q, p in rows if (h, q) == k) / 3 - got[k][1]) + 1e-12 for k in few)  # shrunk toward the host


def test_site_decides_where_evidence_cannot(spark):
    """The same text is kept on a good site and rejected on a bad one."""
    text = "plain words that say nothing either way at all here"
    rows = [(i, text, "good" if i % 2 else "bad", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_bayes.judge(docs.unionByName(docs.where("doc_id = 399")), labels).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(400))


def test_many_sites_take_the_salted_join(docs, spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    few = sorted(map(str, quality_bayes.judge(docs, labels).collect()))
    monkeypatch.setattr(quality_bayes, "BROADCAST_PATHS", 0)
    assert sorted(map(str, quality_bayes.judge(docs, labels).collect())) == few


def test_media_round_trip(docs):
    rows = mpeg.audio_columns(docs).collect()
    want = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = want[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["bad_crc"] == 0 and r["skipped_bytes"] == 0 and r["table_agrees"] and r["duration_us"] == r["n_frames"] * 36_000


def test_parser_resynchronises_and_checks():
    payload = bytes(range(1, 255)) * 30
    stream = mpeg.build(payload)
    clean = mpeg.parse(stream)
    assert mpeg.payload_of(stream, clean) == payload and clean["vbr_frames"] == clean["n_frames"] and clean["seek"][0] > clean["first"]
    begin, _, _ = mpeg.read_tags(stream)
    dirty = stream[:begin] + b"junk\xff\xfbnoise" + stream[begin:] + b"TAG" + b"title".ljust(125, b"\0")
    found = mpeg.parse(dirty)
    assert found["n_frames"] == clean["n_frames"] and found["skipped"] == 11 and found["tags"]["TIT2"] == "title"
    broken = bytearray(stream)
    broken[clean["seek"][0] + 8] ^= 1
    assert mpeg.parse(bytes(broken))["bad_crc"] == 1
    assert mpeg.parse(b"")["n_frames"] == 0 and mpeg.parse(b"ID3")["n_frames"] == 0 and mpeg.parse(stream[:-5])["n_frames"] == clean["n_frames"] - 1


def test_payload_with_tag_letters_is_no_tag(spark):
    lost = []
    for n in (64, 128, 192, 1408, 1472, 2816, 4096):
        blank = mpeg.build(bytes(n))
        bodies = mpeg.parse(blank)["bodies"]
        inside = len(blank) - 128 - bodies[-1][0]
        at = inside + (len(bodies) - 1) * mpeg._FRAMES[-1][0]
        if inside >= 0 and at + 3 <= n:
            payload = (b"x" * at + b"TAG").ljust(n, b"y")
            stream = mpeg.build(payload)
            assert stream[-128:-125] == b"TAG"
            tagged = stream + b"TAG" + b"title".ljust(125, b"\0")
            assert mpeg.parse(tagged)["tags"]["TIT2"] == "title"
            lost += [n for s in (stream, tagged) if mpeg.payload_of(s, mpeg.parse(s)) != payload or "TIT2" in mpeg.parse(stream)["tags"]]
            text = payload.decode()
    assert lost == []
    row = mpeg.audio_columns(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["payload_bytes"], row["payload_sha256"], row["skipped_bytes"]) == (len(text), sha256(text.encode()).hexdigest(), 0)


def test_packing_is_gapless_and_tight(docs, spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    odd = [(900, "two\u2028lines\u00a0of\x1cÉÉ e\u0301 <|endoftext|>x\t'Tis don't 12 ab" + "c" * 50, "s", "en", ""), (901, "word " * 9000, "s", "en", "")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = packing.pack_documents(rows, path).collect()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    bins = {}
    for r in out:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        own = ids[r["start"] : r["start"] + 4096]
        assert r["ids"] == own and r["length"] == len(own) and r["start"] == 4096 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert sum(r["doc_id"] == 901 for r in out) == 3


def test_packing_over_many_shards_reopens_bad_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    rng = Random(7)
    lengths = [rng.choice([100, 900, 1500, 2100, 3000, 4096]) for _ in range(400)]
    out = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")).collect()
    bins = {}
    for r in out:
        bins[r["sequence_id"]] = bins.get(r["sequence_id"], 0) + r["length"]
    assert len(out) == 400 and max(bins.values()) <= 4096 and len(bins) <= 1.1 * sum(lengths) / 4096


def test_crossover_keeps_every_item_once():
    rng, lengths = Random(1), [Random(2).randint(1, 4096) for _ in range(300)]
    one, other = [], []
    for bins, items in ((one, range(300)), (other, reversed(range(300)))):
        room = []
        for i in items:
            packing.best_fit([i], lengths, bins, room, 4096)
    child = packing.crossover(one, other, lengths, 4096, rng)
    assert sorted(i for b in child for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 4096 for b in child)


def hard_lengths():
    """Lengths for bins of 1000 that best fit packs in 44 bins, though 36 hold them."""
    return [510] * 24 + [270] * 24 + [260] * 24 + [230] * 48


def test_crossover_and_migration_beat_best_fit(spark):
    lengths = hard_lengths()
    bins, room = [], []
    packing.best_fit(list(range(len(lengths))), lengths, bins, room, 1000)
    one = [packing.evolve(lengths, [], 1000, Random(f"{s}")) for s in range(3)]
    moved = [packing.evolve(lengths, [one[i], one[i - 1]], 1000, Random(f"{i}x")) for i in range(3)]
    assert len(bins) == 44 and min(map(len, one)) < 44 and min(map(len, moved)) < min(map(len, one))
    assert all(sorted(i for b in x for i in b) == list(range(len(lengths))) and max(sum(lengths[i] for i in b) for b in x) <= 1000 for x in moved)
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    used = {e: packing.pack(rows, capacity=1000, epochs=e).select("sequence_id").distinct().count() for e in (1, 3)}
    assert used[3] < used[1] < 44


def test_token_ids_are_those_of_the_tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = [
        "", None, "Hello, WORLD's  end x", "a\u0301 b\u0301", "<|endoftext|> <|startoftext|>x foo<|ENDOFTEXT|>", "\u03a3\u0391\u03a3 \u03c2\x0b\x0cx\x85y", "x" * 5000, "dogs'. don't! a\u00bb., \u00e9.. \u00c9! \u00d7. x\u00d7.. 5. (a) a<|b|> <|endoftext|>... \u00bd! \u00b2?",
        "x<", "|y endo <|", "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8 \u0308a", "\x1c\x1d a\u00a0b \u3000", "\u0130stanbul \u01c5", "1234 5a6'll I'LL don'T", "\U0001f642\U0001f642 " * 30, "\u1100\u1161\u11a8 \u1100 \u1161", "a. b. " * 40_000,
    ]
    for remembered in (packing.REMEMBERED, 5):
        words = packing.WordIds(path, remembered)
        for _ in range(2):
            for s in slices(pa.array(texts), 3000):
                ids, bounds = words.of(s, 1)
                for r in range(len(s)):
                    want = words.tokenizer.encode(texts[s.first + r] or "", add_special_tokens=False).ids
                    assert ids[bounds[r] : bounds[r + 1]].tolist() == [*want, 1]


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    assert mpeg.audio_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_are_written_by_many_tasks(docs, spark, tmp_path):
    placed = sharding.shards_by_bytes(docs, 4, F.octet_length(F.coalesce("text", F.lit(""))) + 1, ["doc_id"], {"doc_id": F.col("doc_id"), "text": F.col("text")})
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*placed.columns).collect())) == sorted(map(str, placed.collect()))
    for folder in (tmp_path / "shards").glob("shard=*"):
        parts = [[r["slot"] for r in spark.read.parquet(str(f)).collect()] for f in folder.glob("*.parquet")]
        assert all(p == sorted(p) for p in parts)
    sharding.write_shards(placed.where("false"), str(tmp_path / "none"))


def test_many_sources_are_joined_by_shuffle(docs, monkeypatch):
    key = lambda r: str(r)
    few = sorted(mixing.choose_blocks(docs).collect(), key=key)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.choose_blocks(docs).collect(), key=key) == few


def test_shards_take_their_own_seats(docs):
    rows = mixing.choose_blocks(docs).select("*", mixing.shard_words(F.col("picks")).alias("by_shard")).collect()
    sources = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    block, total = mixing.BLOCK_TOKENS, sum(t for _, t in sources.values())
    ends = []
    for shard in range(1, 9):
        quota = dict.fromkeys(names, 0)
        for _ in range(round(total / block * shard / 8)):
            quota[max(names, key=lambda s: (sources[s][1] / (2 * quota[s] + 1), -names.index(s)))] += 1
        ends.append({s: min(q, 2 * -(-sources[s][0] // block)) for s, q in quota.items()})
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert all(sum(r["by_shard"]) == r["taken"] for r in own)
        assert all(len(p["shards"]) == p["rounds"] for r in own for p in r["picks"])
        for shard in range(8):
            seats = ends[shard][s] - (ends[shard - 1][s] if shard else 0)
            assert 0 <= seats * block - sum(r["by_shard"][shard] for r in own) <= 2 * (block - 1)  # the source's last block may be short


def test_places_are_permutations(spark):
    from cueloom.llm.mixing import _PRIMES, _place

    rows = [(b, n) for n in (1, 2, 7, 64, 97) for b in range(n)] + [(b, m * p) for p in _PRIMES for m in (1, 2, 3) for b in range(6)]
    got = spark.createDataFrame(rows, "b long, n long").select("n", _place(F.col("b"), F.col("n"), F.lit(-12345).cast("long")).alias("at")).collect()
    assert len({(r["n"], r["at"]) for r in got}) == len(rows) and all(0 <= r["at"] < r["n"] for r in got)


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_hash", "_n", "_words", "_round", "_mine", "_len", "size", "picks", "taken", "_c_size", "_k0", "a.b", "_row", "_bucket", "_order"]
    rows = [(i, f"word{i} " * 200 if i % 5 else None, f"s{i % 3}", *[i * 100 + k if k % 2 else f"v{i}.{k}" for k in range(len(names))]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` {'long' if k % 2 else 'string'}" for k, n in enumerate(names)))
    out = mixing.mix(docs)
    assert out.dtypes == docs.dtypes
    found = out.collect()
    by_id = {r[0]: r for r in rows}
    assert found and all(tuple(r)[2:] == by_id[r["doc_id"]][2:] for r in found)
    assert {r["doc_id"] for r in found} <= {i for i in range(40) if i % 5}
