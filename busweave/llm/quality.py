"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two logistic models on statistics of whole texts give each document evidence:
that it is of good quality, and that it is toxic (by words that labelled toxic
documents share).  The expected good counts of all documents are summed per host
and per path below it; host rates shrink toward the global rate and path rates
toward their host, with strengths estimated from the spread of the rates, so a
sparse site stays near its prior.  A document's posterior shifts its own log
odds by what its path differs from the whole.

Models are fitted on at most ``fit_rows`` labelled documents, those of the least
hashes of their id; near copies count once.  Everything else covers all rows.

Defined results: null and empty texts are documents without words; null hosts
and paths form their own groups; repeated rows each get their row; conflicting
labels of an id: the lowest counts; without labels of both classes every
document is kept; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from busweave.llm.words import mix, slices, words_of
from busweave.session import settle

FIT_ROWS = 10_000
LEXICON_ROWS = 200
LEXICON_SHARE = 0.03
LEXICON_ODDS = 3.0
THRESHOLD = 0.5

_SYMBOLS = b"#$%&*@<>{}[]|\\^~="
_CLASSES = 5  # symbol, capital, digit, exclamation, other visible
_ENDINGS = ("", ".", ",", "!", "?", ";", ":", "!!")
_FEATURES = 12
_RIDGE = 1.0


def _byte_classes() -> np.ndarray:
    table = np.full(256, 4, np.uint8)
    table[list(_SYMBOLS)] = 0
    table[65:91] = 1
    table[48:58] = 2
    table[33] = 3
    table[[9, 10, 11, 12, 13, 32]] = _CLASSES
    return table


def text_features(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Statistics of each text (row x feature); the last one counts toxic words."""
    raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()
    words = words_of(texts)
    folded = words_of(texts, fold=True)
    toxic = np.cumsum([0, *np.isin(folded.hash, lexicon)]) if len(lexicon) else np.zeros(len(folded.hash) + 1)
    kinds = _byte_classes()
    out = np.zeros((len(raw), _FEATURES))
    for i, body in enumerate(raw):
        a, b = words.first[i], words.first[i + 1]
        n = b - a
        if not n:
            continue
        own = words.hash[a:b]
        _, counts = np.unique(own, return_counts=True)
        kind = np.bincount(kinds[np.frombuffer(body, np.uint8)], minlength=_CLASSES + 1)
        seen = kind[:_CLASSES].sum()
        out[i] = (
            math.log1p(n), len(counts) / n, len(counts) / math.sqrt(n), 10 * kind[0] / seen, 5 * kind[1] / seen,
            10 * kind[2] / seen, kind[3] / n, math.log(seen / n), 5 * counts.max() / n,
            5 * np.count_nonzero(own[1:] == own[:-1]) / n, 2 * len(zlib.compress(body, 1)) / len(body),
            math.log1p(toxic[b] - toxic[a]),
        )
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> dict:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = _RIDGE * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w}


def _log_odds(model: dict | None, x: np.ndarray, default: float) -> np.ndarray:
    if model is None:
        return np.full(len(x), default)
    z = np.c_[np.ones(len(x)), np.clip((x - model["mean"]) / model["scale"], -8, 8)]
    return np.clip(z @ model["w"], -30, 30)


def _hash_words(words) -> np.ndarray:
    return words_of(pa.array([w + e for w in words for e in _ENDINGS], pa.string()), fold=True).hash


def _copy_keys(batches):
    """Two least word hashes: near copies nearly always share them."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), fold=True)
            keys = np.zeros((2, part.num_rows), np.uint64)
            for i in range(part.num_rows):
                own = words.hash[words.first[i] : words.first[i + 1]]
                if len(own):
                    keys[:, i] = own.min(), mix(own + np.uint64(1)).min()
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(k.view(np.int64)) for k in keys]], names=[*part.schema.names, "c1", "c2"]
            )


def fit(docs: DataFrame, labels: DataFrame, text: str, key: str, fit_rows: int = FIT_ROWS) -> dict:
    """Models of quality and toxicity from a bounded sample of labelled documents."""
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__label"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("__label"), "__label").limit(fit_rows)
    )
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__label")
    ).select("doc_id", "text", "quality", "toxic")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = settle(
        rows.mapInArrow(_copy_keys, f"doc_id {kind}, text string, quality int, toxic int, c1 long, c2 long"), "quality-sample"
    )
    single = sample.groupBy("c1", "c2").agg(F.min(F.xxhash64("doc_id")).alias("h"))
    sample = settle(
        sample.join(single, ["c1", "c2"]).filter(F.xxhash64("doc_id") == F.col("h")).select("text", "quality", "toxic"),
        "quality-single",
    )
    totals = {r.toxic: r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    words = F.array_distinct(F.transform(
        F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    ))
    odds = F.log((F.col("k1") + 0.5) / max(bad, 1)) - F.log((F.col("k0") + 0.5) / max(good, 1))
    lexicon = [
        r.word for r in sample.select(F.explode(words).alias("word"), "toxic").filter("word <> ''").groupBy("word")
        .agg(F.count_if(F.col("toxic") > 0).alias("k1"), F.count_if(F.col("toxic") <= 0).alias("k0"))
        .filter((F.col("k1") >= max(3.0, LEXICON_SHARE * bad)) & (odds >= LEXICON_ODDS))
        .orderBy(F.desc("k1"), "word").limit(LEXICON_ROWS).collect()
    ] if bad and good else []
    hashes = _hash_words(lexicon)

    def measure(batches):
        for batch in batches:
            for part in slices(batch):
                x = text_features(part.column("text"), hashes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("quality"), part.column("toxic"),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * _FEATURES), pa.array(x.ravel()))],
                    names=["quality", "toxic", "x"],
                )

    table = sample.mapInArrow(measure, "quality int, toxic int, x array<double>").collect()
    x = np.array([r.x for r in table]).reshape(-1, _FEATURES)
    quality = np.array([r.quality > 0 for r in table], float)
    toxic = np.array([r.toxic > 0 for r in table], float)
    model = lambda columns, y: _logistic(columns, y) if len(y) and 0 < y.sum() < len(y) else None
    return {"lexicon": hashes, "quality": model(x[:, :-1], quality), "toxic": model(x[:, -1:], toxic) if lexicon else None}


def _evidence(models: dict, text: str, passed: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                x = text_features(part.column(text), models["lexicon"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in passed], pa.array(_log_odds(models["quality"], x[:, :-1], 30.0)),
                     pa.array(_log_odds(models["toxic"], x[:, -1:], -30.0))],
                    names=[*passed, "__good", "__toxic"],
                )

    return run


def _shrunk(groups: DataFrame, keys: list[str], total: str, prior, name: str) -> DataFrame:
    """Adds ``name``: the rate of a group shrunk toward ``prior``.

    The strength is that of a beta prior with the groups' mean and variance, the
    sampling variance taken off; it is one global number.
    """
    rate = F.col(total) / F.col("n")
    m = F.least(F.greatest(F.sum(total) / F.sum("n"), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = groups.select(
        m.alias("m"), (F.sum(F.col("n") * rate * rate) / F.sum("n")).alias("s"),
        (F.count("*") / F.sum("n")).alias("c"),
    ).first()
    if spread.s is None:
        strength = 1.0
    else:
        noise = spread.m * (1 - spread.m)
        between = max(spread.s - spread.m**2 - noise * spread.c, 1e-6)
        strength = max(1.0, noise / between - 1)
    prior = F.lit(spread.m) if prior is None else prior
    return groups.withColumn(name, (F.col(total) + strength * prior) / (F.col("n") + strength))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source",
    path: str = "lang", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, carry: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with good, toxic (own evidence), host_rate, path_rate, posterior, keep.

    ``carry`` names the columns to keep (all by default); they are written once
    with the evidence, which the site rates and the rows both read.
    """
    out = ["good", "toxic", "host_rate", "path_rate", "posterior", "keep"]
    models = fit(docs, labels, text, key, fit_rows)
    passed = [c for c in (carry or docs.columns) if c not in out]
    source = docs.select(*passed, F.col(host).alias("__host"), F.col(path).alias("__path"), F.col(text).alias("__text"))
    kept = source.columns[:-1]
    schema = T.StructType([source.schema[c] for c in kept]).add("__good", "double").add("__toxic", "double")
    scored = settle(source.mapInArrow(_evidence(models, "__text", kept), schema), "quality-evidence")
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c)))
    clean = logistic("__good") * (1 - logistic("__toxic"))
    small = settle(scored.select("__host", "__path", clean.alias("p")).groupBy("__host", "__path").agg(
        F.count("*").alias("n"), F.sum("p").alias("s")
    ), "quality-paths")
    hosts = settle(_shrunk(
        small.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), ["__host"], "s", None, "host_rate"
    ).select(F.col("__host").alias("__h"), "host_rate"), "quality-hosts")
    paths = small.join(hosts, F.col("__host").eqNullSafe(F.col("__h")))
    paths = _shrunk(paths, ["__host", "__path"], "s", F.col("host_rate"), "path_rate")
    whole = small.agg(F.sum("s") / F.sum("n")).first()[0]
    whole = min(max(whole if whole is not None else 0.5, 1e-6), 1 - 1e-6)
    paths = settle(paths.select(
        F.col("__host").alias("__h"), F.col("__path").alias("__p"), "host_rate", "path_rate"
    ), "quality-rates")
    bounded = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(bounded / (1 - bounded)) - math.log(whole / (1 - whole))
    own = F.log(F.greatest(clean, F.lit(1e-12))) - F.log(F.greatest(1 - clean, F.lit(1e-12)))
    joined = scored.join(
        paths, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left"
    )
    posterior = 1 / (1 + F.exp(-(own + shift)))
    return joined.select(
        *passed, logistic("__good").alias("good"), logistic("__toxic").alias("toxic"), "host_rate", "path_rate",
        posterior.alias("posterior"), (posterior >= threshold).alias("keep"),
    )


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Evidence, shrunk rates, posterior and decision of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, carry=["doc_id", "source", "lang"])


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
