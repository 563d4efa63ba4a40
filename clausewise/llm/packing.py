"""Packing into optimal length buckets.

A dynamic programme over the global histogram of sequence lengths chooses the bucket lengths
with the least padding; inside a bucket sequences form batches under a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import staged
from clausewise.llm.tokenizer import VOCABULARY, token_count

CONTEXT = 2048
BUCKETS = 16
BATCH_TOKENS = 65_536
SHARD_ROWS = 16_384


def bucket_lengths(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of ``lengths`` (distinct, ascending) that minimise the padding of all sequences.

    best[j] is the least padding of the first j lengths in b buckets; the last of these ends at
    length j and pads everything from i on: l_j * (n_j - n_i) - (t_j - t_i), by prefix sums.
    """
    size = len(lengths)
    if not size:
        return []
    length = np.asarray(lengths, float)
    n = np.concatenate([[0.0], np.cumsum(np.asarray(counts, float))])
    t = np.concatenate([[0.0], np.cumsum(np.asarray(counts, float) * length)])
    pad = length[:, None] * (n[1:, None] - n[None, :-1]) - (t[1:, None] - t[None, :-1])
    pad[np.arange(size)[:, None] < np.arange(size)[None, :]] = np.inf
    best, cuts = np.concatenate([[0.0], np.full(size, np.inf)]), []
    for _ in range(min(buckets, size)):
        cost = best[None, :-1] + pad
        cut = np.argmin(cost, axis=1)
        best = np.concatenate([[0.0], np.minimum(cost[np.arange(size), cut], np.inf)])
        cuts.append(cut)
    ends, at = [], size
    for cut in reversed(cuts):
        if at == 0:
            break
        ends.append(lengths[at - 1])
        at = int(cut[at - 1])
    return ends[::-1]


def pack(
    spark: SparkSession,
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    context: int = CONTEXT,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per sequence: doc_id, piece, start, n_tokens, bucket_tokens, batch_id.

    A document longer than ``context`` is cut into consecutive pieces of ``context`` tokens and a rest,
    so that no token is lost; a document without tokens (null or empty text) has no sequence.
    Every sequence goes to the shortest bucket that holds it. A batch holds sequences of one
    bucket and at most batch_tokens // bucket_tokens of them (one at least). Repeated rows are
    packed again, null ids are kept; other columns are ignored.

    Only the histogram, of ``context`` rows at most, reaches the driver. A bucket is dealt by hash
    into shards of about ``shard_rows`` sequences, in which batches are counted off, so that a bucket
    with most of the rows is as many tasks as it needs.
    """
    lengths = staged(
        documents.select(F.col(doc_id).alias("doc_id"), token_count(spark, F.col(text), vocabulary).alias("n")),
        "packing-lengths",
    )
    pieces = lengths.filter("n > 0").select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / context))).alias("piece")
    )
    sequences = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece") * context).alias("start"),
        F.least(F.col("n") - F.col("piece") * context, F.lit(context).cast("long")).alias("n_tokens"),
    )
    found = sequences.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    ends = bucket_lengths([r["n_tokens"] for r in found], [r["count"] for r in found], buckets)
    if not ends:
        return sequences.select(
            "*", F.lit(0).cast("long").alias("bucket_tokens"), F.lit("").alias("batch_id")
        )
    held, low = [], 0
    for end in ends:
        held.append((end, sum(r["count"] for r in found if low < r["n_tokens"] <= end)))
        low = end
    bucket = F.lit(None).cast("long")
    shards = F.lit(1)
    for end, rows in reversed(held):
        fits = F.col("n_tokens") <= end
        bucket = F.when(fits, F.lit(end).cast("long")).otherwise(bucket)
        shards = F.when(fits, F.lit(-(-rows // shard_rows))).otherwise(shards)
    dealt = sequences.select(
        "*",
        bucket.alias("bucket_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), shards).alias("shard"),
        F.xxhash64("doc_id", "piece").alias("deal"),
    )
    order = Window.partitionBy("bucket_tokens", "shard").orderBy("deal", "doc_id", "piece")
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_tokens")), F.lit(1))
    batch = F.floor((F.row_number().over(order) - 1) / per_batch)
    return dealt.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket_tokens",
        F.concat_ws("-", F.col("bucket_tokens"), F.col("shard"), batch).alias("batch_id"),
    )
