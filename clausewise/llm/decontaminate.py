"""Benchmark decontamination by winnowing.

Of the k-gram hashes under a sliding window the least is kept, on both sides alike, so any
shared span of ``width`` words shares at least one kept hash. Kept hashes are joined; a hit is
extended over the words around it, which travel with the hash, to whole shared windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import alnum_words_of, gram_hashes, staged, word_hashes

WIDTH = 10
GRAM = 6
# size of the map that keeps most unmatched hashes of documents out of the join; fixed, whatever the input
MAP_BITS = 1 << 23

_MARKS = "array<struct<width:int,gram:long,before:int,pos:int,words:string>>"
_MARK_TYPE = pa.list_(
    pa.struct(
        [("width", pa.int32()), ("gram", pa.int64()), ("before", pa.int32()), ("pos", pa.int32()), ("words", pa.string())]
    )
)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash under each window of ``window`` hashes; of equal ones the last."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def marks_of(words: list[bytes], width: int, gram: int, short: list[int], bitmap: np.ndarray | None) -> list[dict]:
    """Kept hashes of a text with the words a shared window can reach, and every gram of the ``short`` widths."""
    hashes = word_hashes(words)
    found = []

    def keep(size: int, reach: int, at: np.ndarray, grams: np.ndarray) -> None:
        values = grams[at]
        if bitmap is not None and len(at):
            slot = values % np.uint64(len(bitmap) * 64)
            seen = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            at, values = at[seen == 1], values[seen == 1]
        for pos, value in zip(at.tolist(), values.astype(np.int64).tolist()):
            low = max(0, pos - reach)
            # one character per byte: equality of words is kept, whatever the bytes are
            told = b" ".join(words[low : pos + size + reach]).decode("latin-1")
            found.append({"width": size + reach, "gram": value, "before": pos - low, "pos": pos, "words": told})

    if len(words) >= width:
        grams = gram_hashes(hashes, gram)
        keep(gram, width - gram, winnow(grams, width - gram + 1), grams)
    for size in short:
        grams = gram_hashes(hashes, size)
        keep(size, 0, np.arange(len(grams)), grams)
    return found


def _marked(df: DataFrame, id_type: str, width: int, gram: int, short: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """(id, text_key, text) to (id, text_key, n_words, marks); ``short`` None: texts under ``width`` are one window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks = [], []
            for text in batch.column("text"):
                words = alnum_words_of(text.as_py())
                own = ([len(words)] if 0 < len(words) < width else []) if short is None else short
                counts.append(len(words))
                marks.append(marks_of(words, width, gram, own, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(marks, _MARK_TYPE)],
                names=["id", "text_key", "n_words", "marks"],
            )

    return df.mapInArrow(run, f"id {id_type}, text_key long, n_words long, marks {_MARKS}")


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, hits, items.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
    window. ``hits`` are the document's (start, end) words under windows that occur in it, sorted;
    ``items`` the ids (as strings, sorted, distinct; null as "") of items with such windows. Null texts
    have no words; repeated rows give repeated results; empty tables give no hits, no rows.
    ``text_key`` is xxhash64 of the text. Other columns are ignored.
    """
    item_type = benchmark.schema[item_id].dataType.simpleString()
    items = staged(
        _marked(_keyed(benchmark, item_id, item_text), item_type, width, gram, None, None).select(
            "id", F.explode("marks").alias("m")
        ),
        "decontaminate-items",
    )
    short = sorted(r["w"] for r in items.select(F.col("m.width").alias("w")).distinct().collect() if r["w"] < width)
    # one row per 64 slots of the map at most; Python sees the hash as unsigned
    slot = (F.shiftrightunsigned("m.gram", 6) % (map_bits // 64)).cast("int")
    bit = F.expr("shiftleft(1L, cast(m.gram & 63 AS INT))")
    bitmap = np.zeros(map_bits // 64, np.uint64)
    for row in items.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        bitmap[row["slot"]] = np.array(row["bits"], np.int64).astype(np.uint64)
    doc_type = documents.schema[doc_id].dataType.simpleString()
    marked = staged(
        _marked(_keyed(documents, doc_id, text), doc_type, width, gram, short, bitmap).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "decontaminate-marks",
    )
    seen = marked.select("row", F.explode("marks").alias("m")).select(
        "row",
        F.col("m.width").alias("width"),
        F.col("m.gram").alias("gram"),
        F.col("m.before").alias("before"),
        F.col("m.pos").alias("pos"),
        F.split("m.words", " ").alias("words"),
    )
    told = items.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"),
        F.col("m.width").alias("width"),
        F.col("m.gram").alias("gram"),
        F.col("m.before").alias("item_before"),
        F.split("m.words", " ").alias("item_words"),
    )

    def equal_window(back):
        start, item_start = F.col("before") - back, F.col("item_before") - back
        fits = (
            (start >= 0)
            & (item_start >= 0)
            & (start + F.col("width") <= F.size("words"))
            & (item_start + F.col("width") <= F.size("item_words"))
        )
        same = F.slice("words", start + 1, F.col("width")) == F.slice("item_words", item_start + 1, F.col("width"))
        return F.when(fits, same).otherwise(False)

    matched = seen.join(told, ["width", "gram"]).select(
        "row",
        "item",
        "width",
        "pos",
        F.filter(F.sequence(F.lit(0), F.lit(width - gram)), equal_window).alias("backs"),
    )
    windows = matched.filter(F.size("backs") > 0).select("row", "item", "width", "pos", F.explode("backs").alias("back"))
    start = (F.col("pos") - F.col("back")).cast("long")
    hits = windows.groupBy("row").agg(
        F.sort_array(
            F.collect_set(F.struct(start.alias("start"), (start + F.col("width")).alias("end")))
        ).alias("hits"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return marked.drop("marks").join(hits, "row", "left").select(
        F.col("id").alias("doc_id"),
        "text_key",
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def words_under(hits: Column) -> Column:
    """Number of words under sorted (start, end) spans."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        hits,
        F.struct(zero.alias("n"), zero.alias("reached")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(h["end"] - F.greatest(acc["reached"], h["start"]), zero)).alias("n"),
            F.greatest(acc["reached"], h["end"]).alias("reached"),
        ),
    )["n"]
