"""Words, row keys and staged tables shared by the operators of this subpackage.

Python-side helpers work on UTF-8 bytes: ASCII case folding and the two word patterns touch
bytes below 0x80 only, so no text has to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import write_shared

# white space that parts words; everything else belongs to a word
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# bytes.translate table of the second word pattern: A-Z folded, every ASCII byte but 0-9 and a-z a space
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of the lineage that outlives executors."""
    with shuffles_dropped(df.sparkSession):
        return write_shared(df, f"llm-{label}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when their query ends, not when the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def remove_shared(spark: SparkSession, what: DataFrame | str) -> None:
    """Deletes a staged table, or a path of the shared folder, that no returned DataFrame reads."""
    names = {what} if isinstance(what, str) else {name.rsplit("/", 1)[0] for name in what.inputFiles()}
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def once(**columns: Column) -> Column:
    """Columns behind a one-row generator, so that Catalyst neither copies nor inlines them."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """A column name that no column of the input has."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def space_words(text: Column) -> Column:
    """Words between ASCII white space, natively; null or blank text gives an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(
        F.array().cast("array<string>")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z folded, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().split() if text else []


def alnum_words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_ALNUM).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` word hashes; empty when there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def covered(starts: Column, width: int | Column) -> Column:
    """Number of positions under windows of one width that begin at ``starts`` (sorted, distinct)."""
    last = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + (s + width) - F.greatest(acc["end"], s.cast("long"))).alias("n"),
            (s + width).cast("long").alias("end"),
        ),
    )
    return last["n"]
