"""Exact token counts of a byte-level BPE vocabulary, as a column.

The pattern that cuts a text into pieces never lets a piece run over a single space between two
other characters, so each such stretch is counted on its own and its count remembered: words
recur, texts don't. A text with any other white space beside a space is encoded whole, except
for very long runs of white space, on which the pattern would overflow the stack: all but the last
character of such a run is one piece by the pattern, so it is encoded as that piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed values: how this vocabulary cuts text into pieces
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BESIDE_SPACE = re.compile(r"\s | \s")
# white space of the pattern (fewer characters than Python's), and the runs that are taken out of a long text
_LONG_TEXT = 100_000
_LONG_RUN = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_REMEMBERED = 400_000
_loaded: dict[bytes, Callable[[str], int]] = {}


def counter(ranks: bytes) -> Callable[[str], int]:
    """Function from a text to its number of tokens; one per worker and vocabulary."""
    if ranks not in _loaded:
        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        coding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        encode = coding.encode_ordinary
        known: dict[str, int] = {}

        def count(text: str) -> int:
            if len(text) <= _LONG_TEXT:
                return count_part(text)
            total = at = 0
            for run in _LONG_RUN.finditer(text):
                # at the end of a text the run is a piece as a whole, else its last character goes with what follows
                end = run.end() if run.end() == len(text) else run.end() - 1
                total += count_part(text[at : run.start()])
                total += len(coding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
                at = end
            return total + count_part(text[at:])

        def count_part(text: str) -> int:
            if _BESIDE_SPACE.search(text):
                return len(encode(text))
            first, *rest = text.split(" ")
            total = len(encode(first))
            for word in rest:
                n = known.get(word)
                if n is None:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    n = known[word] = len(encode(" " + word))
                total += n
            return total

        _loaded[ranks] = count
    return _loaded[ranks]


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of ``text``; null counts as empty. The vocabulary file is read on the driver and sent once."""
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(shared.value)
        for texts in batches:
            yield pd.Series([of(t) if t else 0 for t in texts], dtype="int64")

    return count(text)
