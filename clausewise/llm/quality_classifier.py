"""Quality by importance resampling.

Two generative models of hashed n-grams are fitted, one on labelled good documents and one on the
whole corpus; a document's log weight is the log ratio of its probabilities under them. Adding
Gumbel noise and keeping the k largest draws k documents without replacement by weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import gram_hashes, staged, word_hashes

BUCKETS = 1 << 16
# pseudo-counts per bucket that lend the target model the shape of the corpus: a small sample leans on it
PRIOR = 10
# labelled good documents used for the target model, drawn by hash of their id; also the bound of a broadcast
MAX_LABELLED = 20_000
# words, and runs of symbols: what junk is made of
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x80-\xff]+")
# the cut of the top k is narrowed bin by bin until this many rows are ranked one by one
RANKED_ROWS = 50_000
_BINS = 4096


def features(text: bytes | None, buckets: int) -> np.ndarray:
    """Bucket of every token and of every pair of neighbours."""
    hashes = word_hashes(_TOKEN.findall(text) if text else [])
    grams = np.concatenate([gram_hashes(hashes, 1), gram_hashes(hashes, 2)])
    return (grams % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """``ratio``: log (target / raw probability) by bucket; ``good_share``: labelled share of good documents."""

    ratio: np.ndarray
    good_share: float | None


def fit(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Both models from one pass over all documents.

    ``labels`` (doc_id, quality): documents of quality 1 are the target. Without such labels all
    ratios are 0. Counts are summed in each task first, so what is shuffled is one row per bucket
    and task and what is collected one row per bucket.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    shares = marked.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    good = (
        marked.filter("quality = 1")
        .select(F.col("doc_id").alias("good_id"))
        .distinct()
        .orderBy(F.xxhash64("good_id"), "good_id")
        .limit(max_labelled)
    )
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"))
    # the good side has max_labelled rows at most
    told = rows.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select(
        "text", F.col("good_id").isNotNull().alias("good")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {True: np.zeros(buckets, np.int64), False: np.zeros(buckets, np.int64)}
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def add(good: bool) -> None:
            if waiting[good]:
                sums[good] += np.bincount(np.concatenate(waiting[good]), minlength=buckets)
                waiting[good].clear()

        for batch in batches:
            for text, is_good in zip(batch.column("text"), batch.column("good").to_pylist()):
                waiting[is_good].append(features(text.as_py(), buckets))
                if len(waiting[is_good]) == 256:
                    add(is_good)
        add(True)
        add(False)
        target = sums[True]
        raw = sums[False] + target
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"]
        )

    sums = (
        told.mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in sums:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.any():
        return Model(np.zeros(buckets), shares)
    everything = (raw + 1) / (raw.sum() + buckets)
    wanted = (target + PRIOR * buckets * everything) / (target.sum() + PRIOR * buckets)
    return Model(np.log(wanted / everything), shares)


def log_weight(model: Model, documents: DataFrame, text: str = "text") -> Column:
    """Log importance weight of a text; 0 for null, empty and blank ones."""
    shared = documents.sparkSession.sparkContext.broadcast(model.ratio)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio = shared.value
        for texts in batches:
            yield pd.Series([float(ratio[features(t, len(ratio))].sum()) for t in texts], dtype="float64")

    return weigh(F.col(text).cast("binary"))


def gumbel(key: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise fixed by a document's key and the seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column of finite numbers, found by counting ever narrower bins."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    inside = rows.select(F.col(key).alias("v"))
    while n > RANKED_ROWS and low < high:
        step = (high - low) / _BINS
        bins = F.least(F.floor((F.col("v") - low) / step), F.lit(_BINS - 1))
        counts = inside.groupBy(bins.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in sorted(counts.collect(), key=lambda r: -r["b"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high, n = row["lo"], row["hi"], row["n"]
        inside = inside.filter(F.col("v").between(low, high))
    if low == high:
        return low
    return inside.orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]


def resample(
    documents: DataFrame,
    labels: DataFrame,
    keep_share: float | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED,
) -> tuple[DataFrame, Column, float | None]:
    """Scores, and the decision as a column over any table with these texts.

    Returns (scores, sample_key, cut): ``scores`` has doc_id, log_weight and sample_key per row;
    a document is drawn where its sample_key is at least ``cut``. k is ``keep_share`` of the rows;
    by default the share of good ones among the labelled documents, or all without labels.
    Null and empty texts weigh 0. Rows that tie at the cut are all drawn; repeated rows share
    their fate. No documents: nothing is drawn (``cut`` is None).
    """
    model = fit(documents, labels, doc_id, text, buckets, max_labelled)
    weight = log_weight(model, documents, text)
    scores = staged(
        documents.select(F.col(doc_id).alias("doc_id"), weight.alias("log_weight")).withColumn(
            "sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)
        ),
        "quality-scores",
    )
    if keep_share is None:
        keep_share = 1.0 if model.good_share is None else model.good_share
    k = int(round(keep_share * scores.count()))
    cut = kth_largest(scores, "sample_key", k)
    return scores, weight + gumbel(F.col(doc_id), seed), cut
