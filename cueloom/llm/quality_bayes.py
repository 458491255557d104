"""Quality classifier: document evidence from naive Bayes, with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.columns import exact, set_aside
from cueloom.llm.compression_bands import repeat_words
from cueloom.llm.idfilter import with_ids
from cueloom.llm.textscan import slices

_UPPER, _MARKS, _LETTERS, _DIGITS = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_MARKS[list(b"#*$%&|<>!@^~=_{}[]\\")] = True
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_DIGITS[48:58] = True

#: Upper edges of each feature's classes; what lies beyond the last is a class of its own.
EDGES: dict[str, list[float]] = {
    "upper": [0.02, 0.04, 0.08, 0.15, 0.3, 0.6],
    "marks": [0.0, 0.005, 0.02, 0.05, 0.1, 0.2],
    "marked_words": [0.0, 0.02, 0.05, 0.15, 0.4, 0.7],
    "echo": [0.0, 0.01, 0.03, 0.1, 0.3, 0.6],
    "repeats": [0.0, 0.05, 0.2, 0.4, 0.7],
    "digits": [0.0, 0.01, 0.05, 0.2],
    "word_bytes": [2.5, 3.5, 4.5, 5.5, 7.0, 10.0, 20.0],
    "words": [0.0, 4.0, 10.0, 50.0, 1000.0],
}
#: Rows that each label's class shares are smoothed with, spread as the classes of all labelled rows are.
SMOOTHING = 1.0
#: Documents whose probability of good quality is at least this stay: the even cut of calibrated odds, whatever the number of labels.
THRESHOLD = 0.5
#: Labelled rows are dealt to so many folds by doc_id; each is scored by the others to find how far evidence is overstated.
FOLDS = 5
#: Held-out evidence is counted in bins of this width, so what reaches the driver has a bounded size.
BIN = 0.25
#: Labels up to which they (about 16 bytes each) are broadcast; beyond, they meet rows without texts in a shuffled join, and texts by filters of their ids.
BROADCAST_LABELS = 200_000
#: (host, path) rows up to which the posteriors (about 60 bytes each) are broadcast; beyond, a salted join is used.
BROADCAST_PATHS = 50_000
SALTS = 16


def _features(batch_texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, rows, class of each feature of each row) of slices of a column of texts."""
    for s in slices(batch_texts):
        n_words = np.diff(s.bounds).astype(float)
        n_bytes = np.maximum(np.diff(s.offsets), 1)
        letters = np.maximum(s.count_by_row(_LETTERS[s.data]), 1)
        in_words = s.count_by_row(s.in_word)
        hashes = s.word_hashes()
        marked = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(_MARKS[s.data], out=marked[1:])
        has_mark = np.concatenate([[0], np.cumsum(marked[s.ends] > marked[s.starts])])
        same = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])])[: len(hashes) + 1]
        words = np.maximum(n_words, 1)
        first, last = s.bounds[:-1], s.bounds[1:]
        echo = np.where(last > first, same[last] - same[np.minimum(first + 1, len(same) - 1)], 0)
        repeats = np.array([repeat_words(hashes[a:b]) for a, b in zip(first, last, strict=True)], float)
        values = {
            "upper": s.count_by_row(_UPPER[s.data]) / letters, "marks": s.count_by_row(_MARKS[s.data]) / n_bytes, "marked_words": (has_mark[last] - has_mark[first]) / words,
            "echo": echo / words, "repeats": repeats / words, "digits": s.count_by_row(_DIGITS[s.data]) / n_bytes, "word_bytes": in_words / words, "words": n_words,
        }
        yield s.first, len(s), np.stack([np.searchsorted(EDGES[f], values[f], "left") for f in EDGES], axis=1)


def _classed(weights: np.ndarray | None):
    """Append to rows whose last column is the text: with weights the document's evidence, else the class of each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, n, classes in _features(texts):
                if weights is None:
                    new = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(EDGES)), pa.array(classes.ravel().astype(np.int32)))
                else:
                    new = pa.array(weights[np.arange(len(EDGES)), classes].sum(axis=1))
                kept = [batch.column(c).slice(first, n) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, new], names=[*batch.schema.names[:-1], "_new"])

    return run


def _prepared(docs: DataFrame, keep: list[Column], names: list[str], weights: np.ndarray | None) -> DataFrame:
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_classed(weights), f"{schema}, _new {'array<int>' if weights is None else 'double'}")


def _log_ratios(table: np.ndarray) -> np.ndarray:
    """Log likelihood ratio by feature and class of counts by feature, class and label (0, 1); 0 without both labels."""
    totals = table[0].sum(axis=0)
    if not totals.all():
        return np.zeros(table.shape[:2])
    sizes = np.array([len(e) + 1 for e in EDGES.values()])[:, None]
    pooled = (table.sum(axis=2) + 1 / sizes) / (totals.sum() + 1)
    p = (table + SMOOTHING * pooled[:, :, None]) / (totals + SMOOTHING)[None, None, :]
    return np.log(p[:, :, 1] / p[:, :, 0])


def _lookup(tables: np.ndarray, which: Column) -> Column:
    """The evidence of a row's array of classes under one of several weights by feature and class."""
    weights = F.get(F.array(*[F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in table]) for table in tables]), which)
    return F.aggregate(F.transform("_new", lambda c, f: F.get(F.get(weights, f), c)), F.lit(0.0), lambda a, x: a + x)


def evidence_scale(evidence: np.ndarray, good: np.ndarray, rows: np.ndarray, share: float) -> float:
    """The factor up to 1 under which held-out evidence makes the held-out labels likeliest; 1 without any."""
    factors = np.linspace(0.02, 1, 99)
    logits = np.outer(factors, evidence) + math.log(share / (1 - share))
    loss = (np.logaddexp(0, -logits * np.where(good == 1, 1, -1)) * rows).sum(axis=1)
    return float(factors[len(factors) - 1 - int(np.argmin(loss[::-1]))])


def fit_evidence(classes: DataFrame, good: Column) -> tuple[np.ndarray, float]:
    """(log likelihood ratio by feature and class, share of good documents) of labelled rows with doc_id and an array of classes.

    Features are not independent, so naive Bayes overstates evidence: all ratios are scaled by one factor, fitted to
    evidence that each fold of labelled rows gets from the other folds. Counts come from one grouped aggregation over
    all labelled rows and a second one of their held-out evidence; what reaches the driver has one row per fold,
    feature, class and label, or per bin and label, whatever the input. Without labels of either kind there is no
    evidence: all ratios are 0, and the share is one half when there are none at all.
    """
    rows = classes.where(good.isNotNull()).select(good.cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "_new")
    counts = rows.select("fold", "y", F.posexplode("_new").alias("f", "c")).groupBy("fold", "f", "c", "y").count().collect()
    table = np.zeros((FOLDS, len(EDGES), max(len(e) for e in EDGES.values()) + 1, 2))
    for r in counts:
        table[r["fold"], r["f"], r["c"], r["y"]] += r["count"]
    whole = table.sum(axis=0)
    totals = whole[0].sum(axis=0)
    share = float((totals[1] + 1) / (totals.sum() + 2))
    weights = _log_ratios(whole)
    if not totals.all():
        return weights, share
    held_out = _lookup(np.array([_log_ratios(whole - part) for part in table]), F.col("fold"))
    bins = rows.groupBy(F.round(held_out / BIN).alias("bin"), "y").count().collect()
    return weights * evidence_scale(np.array([r["bin"] * BIN for r in bins]), np.array([r["y"] for r in bins]), np.array([r["count"] for r in bins]), share), share


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def concentration(spread: float | None, mean: float, n: float | None, squares: float | None, groups: int) -> float:
    """How many documents a group's prior is worth, from the spread of the groups' means (method of moments), between 1 and 10000."""
    within, n = mean * (1 - mean), n or 0
    scale = within * (n - (squares or 0) / n - (groups - 1)) if n else 0.0
    rho = ((spread or 0.0) - within * (groups - 1)) / scale if scale > 0 else 0.0
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def site_posteriors(evidence: DataFrame, prior: float) -> DataFrame:
    """(host, path, n, host_posterior, path_posterior) from rows (host, path, p): the share of good documents expected there.

    A host's mean is shrunk toward the global one and a path's toward its host's, each by a concentration estimated
    from how far the means of all hosts, or paths within hosts, spread. Sums go from paths to hosts to the whole, so
    a host with a third of all rows is summed in the tasks that read it. A null host or path is a value of its own.
    """
    paths = freeze(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.coalesce(F.sum("hs") / F.sum("hn"), F.lit(prior)).alias("mean"), F.sum("hn").alias("n"), F.sum(F.col("hn") * F.col("hn").cast("double")).alias("squares"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("ss")).first()
    mean = whole["mean"]
    host_m = concentration((whole["ss"] or 0.0) - (whole["n"] or 0) * mean * mean, mean, whole["n"], whole["squares"], whole["groups"])
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + host_m * mean) / (F.col("hn") + host_m)).withColumnRenamed("host", "_host")
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    inner = both.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("spread"), F.sum(F.col("n") * F.col("n").cast("double") / F.col("hn")).alias("squares"), F.count(F.lit(1)).alias("groups")).first()
    path_m = concentration(inner["spread"], mean, whole["n"], inner["squares"], inner["groups"] - whole["groups"] + 1)
    return both.select("host", "path", "n", "host_posterior", ((F.col("s") + path_m * F.col("host_posterior")) / (F.col("n") + path_m)).alias("path_posterior"))


def _join_sites(rows: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """Rows with their site's posteriors: broadcast while sites are few, else salted."""
    keys = F.struct(F.col(host).alias("host"), F.col(path).alias("path"))  # whole, so nulls meet
    right = sites.select(F.struct("host", "path").alias("_site"), "host_posterior", "path_posterior")
    if sites.count() <= BROADCAST_PATHS:
        return rows.join(F.broadcast(right), keys.eqNullSafe(F.col("_site")), "left").drop("_site")
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(right, keys.eqNullSafe(F.col("_site")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_site", "_salt", "_salt2")


def own_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of labelled documents: null labels and ids are ignored, and a document with several has the lowest."""
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(classed: DataFrame, good: DataFrame) -> tuple[np.ndarray, float, DataFrame]:
    """(document evidence weights, global share of good documents, posteriors of each host and path).

    classed has doc_id, host, path and the classes of all documents, good a label (doc_id, quality) for some. Every
    document counts for its site: labelled ones as labelled, the others with the probability that their own evidence
    and the global share give.
    """
    good = good.withColumnRenamed("quality", "_y")
    rows = classed.select("doc_id", "host", "path", "_new")
    named = rows.where("doc_id is not null").join(good.hint("merge"), "doc_id", "left")  # labels may be many: never broadcast
    labelled = named.unionByName(rows.where("doc_id is null").withColumn("_y", F.lit(None).cast(good.schema["_y"].dataType)))
    weights, share = fit_evidence(labelled, F.col("_y"))
    p = F.coalesce(F.col("_y").cast("double"), 1 / (1 + F.exp(-(_lookup(weights[None], F.lit(0)) + math.log(share / (1 - share))))))
    return weights, share, freeze(site_posteriors(labelled.select("host", "path", p.alias("p")), share), "sites")


def _own_odds(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with evidence, host and path, and probability by these alone."""
    joined = _join_sites(scored, sites, "host", "path")
    return joined.withColumn("probability", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior"))))))


def _stays(probability: Column, threshold: float) -> Column:
    return probability >= threshold - 1e-9  # even odds may round down


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Every document's keep columns with evidence (log likelihood ratio), host_posterior, path_posterior, probability and kept.

    A labelled document's probability is its label. The others' posterior odds are the path's, times the document's
    likelihood ratio. Null and empty texts have evidence like any other (no words); repeated rows are judged alike;
    without labels only the sites' even odds are left and every document stays. Kept columns are shuffled only if there
    are more than BROADCAST_PATHS sites or BROADCAST_LABELS labels.
    """
    own = freeze(own_labels(labels), "labels", few=True)
    names = [f"_k{i}" for i in range(len(keep))]  # clash with nothing
    classed = freeze(_prepared(docs, [F.col("doc_id"), F.col(host), F.col(path), *map(exact, keep)], ["doc_id", "host", "path", *names], None), "classes")
    weights, _, sites = fit(classed, own)
    scored = _own_odds(classed.withColumn("evidence", _lookup(weights[None], F.lit(0))).drop("_new"), sites)
    own = own.select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("_y"))
    if own.count() <= BROADCAST_LABELS:
        joined = scored.join(F.broadcast(own), F.col("doc_id") == F.col("_labelled"), "left")
    else:
        joined = scored.where("doc_id is not null").join(own.hint("merge"), F.col("doc_id") == F.col("_labelled"), "left")
        joined = joined.unionByName(scored.where("doc_id is null"), allowMissingColumns=True)
    joined = joined.withColumn("probability", F.coalesce("_y", "probability")).withColumn("kept", _stays(F.col("probability"), threshold))
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "evidence", "host_posterior", "path_posterior", "probability", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Documents are classed once to fit and once more to decide, where they are read, so texts are not written. Labels meet
    the classes only; what goes to the texts is the ids whose label decides otherwise than their evidence would, a few in
    a hundred labels. Up to BROADCAST_LABELS these are broadcast; beyond, filters part the texts by them in the scan.
    """
    own = freeze(own_labels(labels), "labels", few=True)
    sites_of, all_of = [F.col("doc_id"), F.col(host), F.col(path)], ["doc_id", "host", "path"]
    classed = freeze(_prepared(docs, sites_of, all_of, None), "classes")
    weights, _, sites = fit(classed, own)
    labelled = classed.where("doc_id is not null").join((F.broadcast(own) if own.count() <= BROADCAST_LABELS else own.hint("merge")).withColumnRenamed("quality", "_y"), "doc_id")
    odds = _own_odds(labelled.withColumn("evidence", _lookup(weights[None], F.lit(0))).drop("_new"), sites)
    close = F.abs(F.col("probability") - THRESHOLD) < 1e-6  # sums of floats may differ between the passes
    decided = odds.where(close | (_stays(F.col("probability"), THRESHOLD) != (F.col("_y") == 1)))
    decided = freeze(decided.select(F.col("doc_id").alias("_id"), F.col("_y").alias("_label")).distinct(), "decided", few=True)

    _, names = set_aside(docs)
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    few = decided.count() <= BROADCAST_LABELS
    kind = docs.schema["doc_id"].dataType
    ids = decided.select(F.col("_id").cast(kind).alias("_id"), "_label")
    known = classed.select(F.col("doc_id").alias("_id"))
    rest = docs if few else with_ids(docs, F.col("doc_id"), ids.select("_id"), known, inside=False)
    scored = _own_odds(_prepared(rest, [*sites_of, *map(exact, docs.columns)], [*all_of, *names], weights).withColumnRenamed("_new", "evidence"), sites)
    stays = _stays(F.col("probability"), THRESHOLD)
    if few:
        scored = scored.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left")
        return scored.where(F.coalesce(F.col("_label") == 1, stays)).select(*back)
    saved = freeze(ids.where("_label = 1").select("_id"), "saved", few=True)
    return scored.where(stays).select(*back).union(with_ids(docs, F.col("doc_id"), saved, known, inside=True))
