"""Quality classifier: document evidence shrunk with host and path posteriors (hierarchical empirical Bayes).

Evidence. Two logistic models, for low quality and for toxic texts, over hashed words (present or not) and a few
dense measures of the text; fitted on at most `sample` labelled documents (those of the smallest hashes of doc_id).
Words enter a model only if their counts by class differ clearly, so that chance words of long texts don't add up, and at most `MOST` of them.

Sites. A document's host and path are columns (by default `source` and `lang`). Its evidence, the probability that it
is good, is summed for each path and host by grouped aggregation. A host's posterior mean is shrunk towards the
global mean and a path's towards its host's, with a weight from the spread between sites (method of moments): sparse sites stay near
their parents. A document is good if its log odds plus `site_weight` times the site's shift are positive.

Null and empty texts have the evidence of their measures alone; texts of any length are scored whole. Null hosts or paths are sites of their own. Rows
without a doc_id are judged like others. Labels with nulls are ignored; without labels of both classes a model says
nothing (probability one half of its prior, 0.0) and everything is kept. Repeated rows are judged each by itself. Empty tables
give no rows. Other columns pass untouched, whatever their names but for those added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NARROW, table, written
from .words import SPACE, buffers, scan

#: Hashed word features.
BUCKETS = 1 << 18
#: Sites, or rejected rows, that are sent to all tasks at most.
FEW = 200_000
#: Words that enter a model at most (those whose counts by class differ most).
MOST = 2000
#: Labelled documents that a fit takes at most.
SAMPLE = 20_000
DENSE = ["log_words", "symbol_share", "bar_share", "repeat_share", "distinct_share", "word_length", "capital_share", "digit_share"]
_CLASSES = np.zeros((4, 256), dtype=np.float32)
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum() and chr(_c) not in ".,;:'\"-()?":
        _CLASSES[0, _c] = 1
_CLASSES[1, ord("|")] = 1
_CLASSES[2, 65:91] = 1
_CLASSES[3, 48:58] = 1


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the texts: dense measures, and the word features as (text within the piece, bucket), each once."""
    for w in scan(column, SPACE):
        n = w.n_texts
        bounds = w.bounds()
        words = np.diff(bounds)
        size = np.maximum(np.diff(w.offsets), 1)
        owner = w.text - w.first_text
        sums = [np.add.reduceat(np.append(c[w.data], 0), np.minimum(w.offsets[:-1], len(w.data))) * (np.diff(w.offsets) > 0) for c in _CLASSES]
        same = np.zeros(len(owner))
        if len(owner) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        keys = np.unique((owner.astype(np.int64) << 40) | (w.hash & np.uint64((1 << 40) - 1)).astype(np.int64))
        distinct = np.bincount(keys >> 40, minlength=n)
        some = np.maximum(words, 1)
        length = np.bincount(owner, weights=w.end - w.start, minlength=n)
        dense = np.stack([np.log1p(words), sums[0] / size, sums[1] / size, np.bincount(owner, weights=same, minlength=n) / some, distinct / some, length / some, sums[2] / size, sums[3] / size], axis=1)
        yield dense, *stripped(w, owner)


def stripped(w, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between any white space or punctuation, as (text within the piece, bucket), each once."""
    from .words import BREAK, _scan

    inner = _scan(w.data, w.offsets, 0, BREAK)
    keys = np.unique((inner.text.astype(np.int64) << 18) | (inner.hash & np.uint64(BUCKETS - 1)).astype(np.int64))
    return keys >> 18, keys & (BUCKETS - 1)


@dataclass
class Logistic:
    """Weights of the chosen buckets (by bucket, 0 elsewhere) and of the standardised dense measures."""

    words: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    dense: np.ndarray
    bias: float

    def logit(self, dense: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Log odds of each text."""
        z = np.clip((dense - self.mean) / self.sd, -6, 6)
        use = np.flatnonzero(self.words[bucket])
        return self.bias + z @ self.dense + np.bincount(text[use], weights=self.words[bucket[use]], minlength=len(dense))


def fit(dense: np.ndarray, text: np.ndarray, bucket: np.ndarray, y: np.ndarray, most: int = MOST, rounds: int = 300) -> Logistic:
    """A logistic model by gradient descent with momentum, on the words whose presence differs by over 4.5 deviations."""
    n, good = len(y), int(y.sum())
    mean, sd = (dense.mean(0), np.maximum(dense.std(0), 1e-6)) if n else (np.zeros(len(DENSE)), np.ones(len(DENSE)))
    weights = np.zeros(BUCKETS)
    if good < 3 or n - good < 3:
        return Logistic(weights, mean, sd, np.zeros(len(DENSE)), -20.0)
    all_, hit = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, weights=y[text], minlength=BUCKETS)
    p = good / n
    score = (hit - all_ * p) / np.sqrt(np.maximum(all_ * p * (1 - p), 1e-9) + 0.5)
    chosen = np.argsort(-np.abs(score))[:most]
    chosen = chosen[(np.abs(score[chosen]) > 4.5) & (hit[chosen] + 0 >= 3)]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    use = np.flatnonzero(place[bucket] >= 0)
    row, col = text[use], place[bucket[use]]
    z = np.clip((dense - mean) / sd, -6, 6)
    w, d, b = np.zeros(len(chosen)), np.zeros(z.shape[1]), np.log(p / (1 - p))
    vw, vd, vb, rate = 0.0, 0.0, 0.0, 2.0
    each = np.where(y > 0, 0.5 / good, 0.5 / (n - good))  # both classes weigh the same
    b = 0.0
    for _ in range(rounds):
        logit = b + z @ d + np.bincount(row, weights=w[col], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * each
        vw = 0.9 * vw - rate * (np.bincount(col, weights=error[row], minlength=len(chosen)) + 1e-4 * w)
        vd = 0.9 * vd - rate * (z.T @ error + 1e-4 * d)
        vb = 0.9 * vb - rate * error.sum()
        w, d, b = w + vw, d + vd, b + vb
    weights[chosen] = w
    return Logistic(weights, mean, sd, d, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Logistic]:
    """The models `low` (quality 0) and `toxic`, from at most `sample` labelled documents."""
    chosen = labels.select("doc_id", "quality", "toxic").dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` short rows, so they may go to every task
    rows = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for dense, text, bucket in features(batch.column("text")):
                cut = np.searchsorted(text, np.arange(len(dense) + 1))
                n = len(dense)
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(at, n), batch.column("toxic").slice(at, n), pa.array(list(dense)), pa.array([bucket[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary())], ["quality", "toxic", "dense", "words"])
                at += n

    kind = lambda c: labels.schema[c].dataType.simpleString()
    found = rows.select("doc_id", "text", "quality", "toxic").mapInArrow(run, f"quality {kind('quality')}, toxic {kind('toxic')}, dense array<double>, words binary").collect()
    dense = np.array([r.dense for r in found], np.float64).reshape(-1, len(DENSE))
    words = [np.frombuffer(r.words, np.int32) for r in found]
    bucket = np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int64)
    text = np.repeat(np.arange(len(found)), [len(x) for x in words]).astype(np.int64)
    low, toxic = np.array([r.quality == 0 for r in found], np.float64), np.array([r.toxic == 1 for r in found], np.float64)
    return {"low": fit(dense, text, bucket, low), "toxic": fit(dense, text, bucket, toxic)}


def scored(docs: DataFrame, models: dict[str, Logistic]) -> DataFrame:
    """`docs` without its text, with `p_low` and `p_toxic`, the models' probabilities, and the text's hash `_text`."""
    names = ["p_low", "p_toxic"]
    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(*own, F.xxhash64("text").alias("_text"), F.col("text").cast("string").alias("text"))
    kept = [*own, "_text"]
    schema = T.StructType([*[rows.schema[c] for c in kept], *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0))]
            for dense, text, bucket in features(batch.column("text")):
                found.append(np.stack([1 / (1 + np.exp(-np.clip(models[k].logit(dense, text, bucket), -30, 30))) for k in ("low", "toxic")]))
            p = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p[0]), pa.array(p[1])], [*kept, *names])

    return rows.mapInArrow(run, schema)


def sites(evidence: DataFrame) -> tuple[DataFrame, float]:
    """For each host and path of `evidence(host, path, good)` the shrunk posterior mean, and the global mean."""
    paths = written(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((total.s or 0.0) / max(total.n or 0, 1), 0.01), 0.99)
    # spread between sites beyond that of chance: the weight of the prior in documents
    spread = lambda rows, n, s, prior: rows.agg((F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)) - F.count("*") * mean * (1 - mean)).alias("b"), (F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n)).alias("w")).first()
    weight = lambda x: mean * (1 - mean) / max((x.b or 0.0) / max(x.w or 1.0, 1.0), 1e-4)
    k = weight(spread(hosts, "hn", "hs", F.lit(mean)))
    hosts = hosts.withColumn("host_mean", (F.col("hs") + k * mean) / (F.col("hn") + k))
    both = written(paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "site-hosts")
    k = weight(spread(both, "n", "s", F.col("host_mean")))
    out = both.withColumn("path_mean", (F.col("s") + k * F.col("host_mean")) / (F.col("n") + k))
    return written(out.select("host", "path", "host_mean", "path_mean"), "site-posteriors"), mean


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", site_weight: float = 0.25, sample: int = SAMPLE) -> DataFrame:
    """`docs` without its text, with p_low, p_toxic, host_mean, path_mean, p_good and kept (columns of these names are replaced).

    Texts are scored once, into a written table of narrow rows; `_text` there is the text's hash.
    """
    models = train(docs, labels, sample)
    added = ["p_low", "p_toxic", "host_mean", "path_mean", "p_good", "kept", "_text", "_host", "_path"]
    key = lambda c: F.col(c).cast("string")
    rows = docs.drop(*added).withColumn("_host", key(host)).withColumn("_path", key(path))
    rows = written(scored(rows, models), "site-evidence", NARROW)
    good = (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    posterior, mean = sites(rows.select(F.col("_host").alias("host"), F.col("_path").alias("path"), good.alias("good")))
    posterior = posterior.withColumnsRenamed({"host": "_site_host", "path": "_site_path"})
    # a path with much of all rows is one row of the posterior: sent to all tasks if there are few
    few = posterior.limit(FEW + 1).count() <= FEW
    rows = rows.join(F.broadcast(posterior) if few else posterior, F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path")), "left")
    odds = lambda p: F.log(p / (1 - p))
    p = F.least(F.greatest(good, F.lit(1e-6)), F.lit(1 - 1e-6))
    total = odds(p) + site_weight * (odds(F.coalesce("path_mean", F.lit(mean))) - float(np.log(mean / (1 - mean))))
    rows = rows.withColumn("p_good", 1 / (1 + F.exp(-total)))
    return rows.withColumn("kept", F.col("p_good") >= 0.5).drop("_site_host", "_site_path", "_host", "_path")


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """`docs` without the rows that `classified` rejects; equal texts of one doc_id, host and path are judged alike."""
    keys = ["doc_id", host, path]
    gone = classified(docs, labels, host, path).where("not kept").select(*[F.col(c).alias(f"_gone{i}") for i, c in enumerate(keys)], F.col("_text").alias("_gone_text")).distinct()
    gone = written(gone, "site-rejected", NARROW)
    few = gone.limit(FEW + 1).count() <= FEW
    same = F.xxhash64("text") == F.col("_gone_text")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_gone{i}"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def op3_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "source", "lang", *[F.round(c, 6).alias(c) for c in ("p_low", "p_toxic", "host_mean", "path_mean", "p_good")], "kept")
