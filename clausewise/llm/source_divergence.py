"""Source divergence: how far the term shares of sources of one language lie apart, and by which terms.

Texts are cut by one translate table (letters lowered, everything else below 0x80 a blank) and
counted by one Counter a document; workers add the counters of a source up before anything is
shuffled. Only terms that occur travel on. For two sources the sum over all kept terms is taken
apart: terms of the one, terms of the other, a correction where both have the term, and a constant
for each of the V terms, so work follows the places where sources meet, not V times all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import staged

# fixed values: documents a term must have, the scale of shares, ranks told of terms
LEAST_DOCUMENTS, SCALE, RANKS = 10, 1_000_000_000, 10
# A-Z lowered; letters and bytes beyond ASCII stay, all others become blanks
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
# what a worker holds: bytes of a text split at a time, terms added up before they are passed on
_SPLIT, _HELD = 1 << 20, 300_000
# what a task compares: sources of a tile (about), kept terms of a slice (about), meetings at a time
TILE, SLICE, _AT_ONCE = 512, 4096, 1 << 19


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of a text of any length."""
    blanked = text.translate(_LETTERS)
    counts: Counter = Counter()
    at = 0
    while at < len(blanked):
        end = at + _SPLIT
        if end >= len(blanked):
            end = len(blanked)
        else:
            cut = blanked.rfind(b" ", at + 1, end)
            cut = cut if cut > 0 else blanked.find(b" ", end)
            end = cut if cut > 0 else len(blanked)
        counts.update(blanked[at:end].split())
        at = end
    return counts


_COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("documents", pa.int64())]
)


def _told(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        # a row without a term says that the source occurs
        terms = [b"", *occurrences]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()),
                pa.array([0, *occurrences.values()], pa.int64()),
                pa.array([0, *(documents[t] for t in occurrences)], pa.int64()),
            ],
            schema=_COUNTED,
        )
    held.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            counts = term_counts(text)
            size -= len(documents)
            occurrences.update(counts)
            documents.update(counts.keys())
            size += len(documents)
            if size >= _HELD:
                yield from _told(held)
                size = 0
    yield from _told(held)


def counted(docs: DataFrame) -> DataFrame:
    """Kept terms (lang, source, term, n) with their count in the language and ``head``, true once a kept term;
    and a row with an empty term for each (lang, source)."""
    read = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    by_source = (
        read.mapInArrow(_count, "lang string, source string, term binary, n long, documents long")
        .repartition("lang", "term")  # workers have added up already; one shuffle serves both levels
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )
    term = Window.partitionBy("lang", "term")
    return (
        by_source.withColumn("lang_n", F.sum("n").over(term))
        .withColumn("lang_documents", F.sum("documents").over(term))
        .withColumn("head", (F.row_number().over(term.orderBy("source")) == 1) & (F.length("term") > 0))
        .filter((F.col("lang_documents") >= LEAST_DOCUMENTS) | (F.length("term") == 0))
        .select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "head")
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact for any count; 1 where no term is kept."""
    below = total + 2 * terms
    fits = n < 9_000_000_000
    plain = F.call_function("div", F.when(fits, n + 2).otherwise(0) * SCALE, below)
    wide = F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(19,0)"))
    return 1 + F.when(terms == 0, 0).when(fits, plain).otherwise(wide).cast("long")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def _one_sided(source: np.ndarray, p: np.ndarray, zero: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each source and other source: sum over the terms of the source as if the other had none."""
    out = np.zeros((len(zero), len(others)), np.int64)
    if len(source):
        pairs, times = np.unique(np.stack([source, p]), axis=1, return_counts=True)
        step = max(1, _AT_ONCE // max(1, len(others)))
        for lo in range(0, len(times), step):
            s, share, n = pairs[0, lo : lo + step], pairs[1, lo : lo + step, None], times[lo : lo + step, None]
            np.add.at(out, s, n * (_apart(share, others) - _apart(zero[s][:, None], others)))
    return out


def tile_sums(group: pd.DataFrame) -> pd.DataFrame:
    """Partial sums between the sources of two tiles over the terms of one slice.

    Rows without a term hold the sources, with their share of an absent term as ``p``.
    """
    here, there, piece = (int(group[c].iloc[0]) for c in ("here", "there", "piece"))
    absent = group["term"].isna()
    names, zero, codes, shares, terms = [], [], [], [], []
    term_codes = pd.factorize(group["term"])[0]
    for tile in (here, there):
        known = group[absent & (group["tile"] == tile)].drop_duplicates("source").sort_values("source")
        names.append(known["source"].to_numpy())
        zero.append(known["p"].to_numpy(np.int64))
        mine = (~absent & (group["tile"] == tile)).to_numpy()
        code = pd.Index(names[-1]).get_indexer(group["source"].to_numpy()[mine])
        order = np.argsort(term_codes[mine], kind="stable")
        codes.append(code[order])
        shares.append(group["p"].to_numpy(np.int64)[mine][order])
        terms.append(term_codes[mine][order])
    out = _one_sided(codes[0], shares[0], zero[0], zero[1]) + _one_sided(codes[1], shares[1], zero[1], zero[0]).T
    lo = np.searchsorted(terms[1], terms[0], "left")
    n = np.searchsorted(terms[1], terms[0], "right") - lo
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _AT_ONCE, "right")))
        times = n[start:stop]
        i = np.repeat(np.arange(start, stop), times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[start:stop], times)
        a, b = codes[0][i], codes[1][j]
        pa_, pb = shares[0][i], shares[1][j]
        a0, b0 = zero[0][a], zero[1][b]
        np.add.at(out, (a, b), _apart(pa_, pb) - _apart(pa_, b0) - _apart(a0, pb) + _apart(a0, b0))
        start = stop
    if piece == 0:
        kept = int(group["kept"].iloc[0])
        out += kept * _apart(zero[0][:, None], zero[1][None, :])
    a, b = np.indices(out.shape)
    told = (a < b) if here == there else np.ones(out.shape, bool)
    return pd.DataFrame({"lang": group["lang"].iloc[0], "a": names[0][a[told]], "b": names[1][b[told]], "value": out[told]})


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of ``docs`` (text, lang, source).

    Part ``pair`` ranks all other sources of the language, part ``term`` the ten terms by which a
    source exceeds its language most; ties by the item. Nulls are empty strings, empty texts have no
    terms, repeated rows are documents of their own, and no rows give no rows; other columns are
    ignored. Sources stand in tiles by hash and terms in slices, so a task holds at most about two
    tiles and one slice, whatever the number of sources, terms or documents of a language; the
    report itself has a row for each pair of sources.
    """
    counts = staged(counted(docs), "divergence-counts")
    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.sum(F.col("head").cast("long")).alias("kept"),
        F.sum((F.length("term") == 0).cast("long")).alias("sources"),
    )
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    slices = F.greatest(F.ceil(F.col("kept") / SLICE).cast("int"), F.lit(1))
    sources = staged(
        by_source.join(by_lang, "lang").select(
            "lang",
            "source",
            "total",
            "lang_total",
            "kept",
            tiles.alias("tiles"),
            slices.alias("slices"),
            F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"),
        ),
        "divergence-sources",
    )
    share = _share(F.col("n"), F.col("total"), F.col("kept"))
    known = counts.filter(F.length("term") > 0).join(sources, ["lang", "source"])
    return _pairs(sources, known.withColumn("p", share)).unionByName(_terms(known.withColumn("p", share)))


def _terms(known: DataFrame) -> DataFrame:
    p, q = F.col("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    # p and q are below 2^30, so the square fits
    value = F.call_function("div", (p - q) * (p - q), p + q)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (
        known.filter((F.col("n") > 0) & (p > q))
        .select("lang", "source", "term", value.alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= RANKS)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def _pairs(sources: DataFrame, known: DataFrame) -> DataFrame:
    present = sources.select(
        "lang", "source", "tile", "tiles", "kept",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("piece"),
        F.lit(None).cast("string").alias("term"),
        _share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"),
    )
    postings = known.select(
        "lang", "source", "tile", "tiles", "kept",
        F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("piece"), "term", "p",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = (
        present.unionByName(postings)
        .select("*", other)
        .withColumn("here", F.least("tile", "other"))
        .withColumn("there", F.greatest("tile", "other"))
        .select("lang", "here", "there", "piece", "tile", "source", "kept", "term", "p")
    )
    sums = (
        rows.groupBy("lang", "here", "there", "piece")
        .applyInPandas(tile_sums, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    both = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "value", both).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )
