"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line goes when an earlier line (by doc_id, then line number) has a token set with Jaccard
similarity of at least ``percent`` / 100. Equal lines are settled by a grouped minimum. For the rest,
a set's tokens are ordered from long to short, which is mostly from rare to common. A token that only one
of two sets has parts at most two pairs of neighbours in its own set and one in the other, so similar sets
share a pair of neighbours, one of the first few of both: these pairs are joined, and length and a
bitmap of the set, wider for longer sets, rule most candidates out before the sets are compared.

Pairs of neighbours are many times the lines. They are kept with their line and dealt out in a few passes, a
part of the keys in each: what a pass moved and stored goes when it ends.

In a crowd of near copies all pairs would be too many, and one earlier line is enough. So each
row first meets the earliest and the previous line of its pair and length; where
one of them looks similar, the row is not joined further. Of every line the likeliest earlier
one is confirmed first; only lines for which that fails are compared with all that may match.

Texts are moved as little as that allows: a line is cut out where its text lies, and only lines that a bitmap of the
wanted ones lets through are sent on. Words are compared by 64-bit hashes, equal lines by 128 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import SPACE, SPACE_CLASS, free_name, once, remove_shared, shuffles_dropped, staged
from clausewise.operators.skew import hot_keys, salted_join
from clausewise.session import scratch_dir

PERCENT = 80
# every line with a word takes part; callers may leave shorter lines alone
MIN_WORDS = 1
# bits of a membership bitmap at least, and at most; powers of two
SLOTS = 1 << 20
MOST_SLOTS = 1 << 28
# a key that more lines have is dealt over several tasks
SPLIT_LINES = 1 << 20
# at this or less, short sets that are similar may share no neighbours
_SINGLE_PERCENT = 75
# bits of a key, and the largest size of a set that is told apart from larger ones
_KEY_BITS = 48
_MOST_SIZE = (1 << 16) - 1
# sets of these sizes and more have two and four words of bitmap; one word has as many bits set for any two long sets
_WIDE = (72, 160)
_BITS = ("bits", "bits1", "bits2", "bits3")
_ROW = ("doc_id", "line_no", "size", *_BITS)
# most words of the bitmap that rules pairs out before lines are moved, and tokens to a word up to there
_MOST_WORDS = 64
_WORD_TOKENS = 16
# most parts in which the keys are dealt out one after the other, and keys that are worth a part of their own
PASSES = 4
PASS_KEYS = 1 << 20
_LINE = ["doc_id", "line_no"]


def _spaced(text: Column) -> Column:
    """``text`` with spaces for all other white space that parts words; line feeds stay."""
    odd = SPACE.replace(" ", "").replace("\n", "")
    return F.when(text.rlike(f"[{odd}]"), F.translate(text, odd, " " * len(odd))).otherwise(text)


def _wordy(line: Column, min_words: int) -> Column:
    """Whether a trimmed line has that many words."""
    if min_words == 1:
        return F.length(line) > 0
    return line.rlike(rf"^[^\x20\x09-\x0D]+({SPACE_CLASS}+[^\x20\x09-\x0D]+){{{min_words - 1}}}")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line_no (from 0), line: the lines that count, lower-cased and trimmed."""
    low = docs.select("doc_id", once(low=F.lower("text")))
    cut = low.select("doc_id", F.posexplode(F.split(_spaced(F.col("low")), "\n")).alias("line_no", "line"))
    return cut.select("doc_id", "line_no", F.trim("line").alias("line")).filter(_wordy(F.col("line"), min_words))


def _line_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line_no, a, b): 128 bits of every line that counts; lines that differ in white space only may differ."""
    low = docs.select("doc_id", once(low=F.lower("text")))
    cut = low.select("doc_id", F.posexplode(F.split("low", "\n")).alias("line_no", "line"))
    cut = cut.select(*_LINE, F.trim("line").alias("line"))
    # other white space that a line begins with sorts before any printed character
    cut = cut.select(*_LINE, F.when(F.col("line") < "!", F.btrim("line", F.lit(SPACE))).otherwise(F.col("line")).alias("line"))
    cut = cut.filter(_wordy(F.col("line"), min_words))
    return cut.select(*_LINE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))


def _words(line: Column, number: Callable[[Column], Column]) -> Column:
    """The distinct numbers of a line's words."""
    found = F.array_distinct(F.transform(F.split(line, " "), number))
    return F.array_remove(found, number(F.lit("")))


# words of a bitmap that are put together in one row before the rows are
_STRETCH = 1024


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(F.xxhash64(*keys).alias("hash"))


def _slots(hashed: Column, slots: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(slots - 1)) for h in (hashed, F.shiftrightunsigned(hashed, 32))]


def _bit(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(63)).cast("int")


def _members(hashes: DataFrame, slots: int) -> tuple[Column, int]:
    """A bitmap of a staged set of hashes, an array of 64-bit words, and its bits. One row, of bounded size."""
    slots = min(max(slots, 1 << (16 * hashes.count()).bit_length()), max(slots, MOST_SLOTS))
    marks = hashes.select(F.explode(F.array(*_slots(F.col("hash"), slots))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("slot")))
    marks = marks.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(bit).alias("word"))
    filled = hashes.sparkSession.range(slots // 64).join(marks, "id", "left")
    word = F.coalesce("word", F.lit(0).cast("long")).alias("word")
    stretches = filled.select((F.col("id") / _STRETCH).cast("int").alias("at"), F.struct("id", word).alias("x"))
    stretches = stretches.groupBy("at").agg(
        F.transform(F.sort_array(F.collect_list("x")), lambda x: x["word"]).alias("words")
    )
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))
    return staged(stretches.agg(whole.alias("words")), "lines-members").scalar(), slots


def _inside(hashed: Column, members: tuple[Column, int]) -> Column:
    """Whether the bitmap may hold a hash; false is certain."""
    words, slots = members
    a, b = (
        F.call_function("shiftright", F.get(words, F.shiftright(slot, 6).cast("int")), _bit(slot)).bitwiseAND(F.lit(1)) == 1
        for slot in _slots(hashed, slots)
    )
    return a & b


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, line_no): the lines that equal an earlier line."""
    first = keyed.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = staged(first.filter("n > 1"), "lines-first")
    # a line that makes up a large share of all copies is dealt over several tasks
    hot = hot_keys(first, ["a", "b"], "n")
    later = salted_join(keyed, first.select("a", "b", "first"), ["a", "b"], hot, ["doc_id", "line_no"]).filter(
        F.struct("doc_id", "line_no") > F.col("first")
    )
    return later.select("doc_id", "line_no").distinct()


def _fresh(docs: DataFrame, keyed: DataFrame, copies: DataFrame, min_words: int, slots: int) -> DataFrame:
    """As ``_lines``, without the copies but for a few.

    Lines outside the bitmap of the copies are none. The others that are none have a bitmap of their own; the few
    copies that it lets through too only take part in vain.
    """
    here = F.xxhash64(*_LINE)
    copied = _members(_hashed(copies, *_LINE), slots)
    beyond = keyed.filter(_inside(here, copied)).select(*_LINE).join(copies, _LINE, "left_anti")
    spared = _members(_hashed(staged(beyond.distinct(), "lines-spared"), *_LINE), slots)
    return _lines(docs, min_words).filter(~_inside(here, copied) | _inside(here, spared))


def _flipped(ids: Column) -> Column:
    """The parity of hashes by their last six bits."""
    return F.aggregate(
        ids,
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(i))),
    )


def _keyed_lines(lines: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line_no, size, bits, bits1, bits2, bits3, keys): the hashes of the first pairs of neighbours of every line's token set.

    ``bits`` is the parity of the set's hashes by their last six bits; ``bits1`` is that of every second hash by the seventh
    bit, ``bits2`` and ``bits3`` are those of every fourth, null for smaller sets (``_WIDE``). See ``_apart``.
    """
    # a token's number: longer tokens first (of 256 bytes and more anywhere, but always at one place), then by hash
    number = lambda t: F.bitwise_not(
        F.shiftleft(F.octet_length(t).cast("long"), 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(t), 9))
    )
    numbered = lines.select(*_LINE, once(ids=F.sort_array(_words(F.col("line"), number))))
    # the two bits above those of a bitmap's word tell one word of four from the others
    above = lambda i, mask: F.shiftrightunsigned(i, 6).bitwiseAND(F.lit(mask))
    some = lambda mask, n: _flipped(F.filter("ids", lambda i: above(i, mask) == n))
    bits = {
        "bits": _flipped(F.col("ids")),
        "bits1": F.when(F.size("ids") >= _WIDE[0], some(1, 1)),
        "bits2": F.when(F.size("ids") >= _WIDE[1], some(3, 2)),
        "bits3": F.when(F.size("ids") >= _WIDE[1], some(3, 3)),
    }
    size = F.size("ids")
    if percent > _SINGLE_PERCENT:
        # with sizes s >= t and an overlap of o, 2 (s - o) + (t - o) pairs of the larger set are not in the other
        n = F.floor(size * (2 * (100 - percent)) / 100).cast("int") + 1
        grams = F.zip_with(F.slice("ids", 1, n), F.slice("ids", 2, n), lambda x, y: F.xxhash64(x, y))
    else:
        grams = F.transform(F.slice("ids", 1, F.floor(size * (100 - percent) / 100).cast("int") + 1), lambda x: F.xxhash64(x))
    keys = F.transform(grams, lambda g: F.shiftrightunsigned(g, 64 - _KEY_BITS))
    told = numbered.select(*_LINE, once(size=F.least(size, F.lit(_MOST_SIZE)), keys=keys, **bits))
    return told.select(*_ROW, "keys")


def _exploded(keyed_lines: DataFrame) -> DataFrame:
    """(doc_id, tag, line_no and bitmap): a row for each key of a line, ``tag`` the size of the set above the key."""
    rows = keyed_lines.select(*_ROW, F.explode("keys").alias("key"))
    tag = F.shiftleft(F.col("size").cast("long"), _KEY_BITS).bitwiseOR(F.col("key"))
    return rows.select("doc_id", tag.alias("tag"), *_BITS, "line_no")


def _keyed_rows(lines: DataFrame, percent: int) -> DataFrame:
    """A row for each of the first pairs of neighbours of every line's token set."""
    return _exploded(_keyed_lines(lines, percent))


def _key() -> Column:
    return F.col("tag").bitwiseAND(F.lit((1 << _KEY_BITS) - 1))


def _similar_length(percent: int, a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _few_apart(percent: int, apart: Column, total: Column) -> Column:
    return apart * (100 + percent) <= total * (100 - percent)


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(key, n, doc_id, line_no, size and bitmap): the rows whose key another line has that may be similar.

    ``n`` is the number of rows of the key. Most keys have one row, most others two that the aggregates rule out.
    """
    size = F.shiftrightunsigned("tag", _KEY_BITS).cast("int")
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _key())
    keys = dealt.groupBy(_key().alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(size).alias("total"),
        *[F.when(F.count(c) != 1, F.bit_xor(c)).alias(c) for c in _BITS],
        F.bit_xor("doc_id").alias("doc"),
        F.bit_xor("line_no").alias("line"),
    )
    # of two rows the exclusive or tells in how many bits their sets differ, and whether both are of one line
    apart = _bits_set(*[F.col(c) for c in _BITS])
    two = _few_apart(percent, apart, F.col("total")) & ((F.col("doc") != 0) | (F.col("line") != 0))
    shared = keys.filter((F.col("n") > 2) | ((F.col("n") == 2) & two)).select("key", "n")
    told = dealt.select(_key().alias("key"), *_LINE, size.alias("size"), *_BITS)
    return told.join(shared.hint("shuffle_hash"), "key")


def _may_match(percent: int, a: str, b: str) -> Column:
    """Length and bitmap filters between two rows that share a key."""
    ca, cb = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    total = ca("size") + cb("size")
    return _similar_length(percent, ca("size"), cb("size")) & _few_apart(percent, _apart(a, b), total)


def _bits_set(x: Column, x1: Column, x2: Column, x3: Column) -> Column:
    """Bits set in the bitmap that ``_BITS`` tell, of as many words as are not null."""
    two = F.bit_count(x.bitwiseXOR(x1)) + F.bit_count(x1)
    # of four words the first two are the words of two without the third and the fourth
    four = F.bit_count(x.bitwiseXOR(x1).bitwiseXOR(x2)) + F.bit_count(x1.bitwiseXOR(x3)) + F.bit_count(x2) + F.bit_count(x3)
    return F.coalesce(four, two, F.bit_count(x))


def _apart(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ, in as many words as the smaller has."""
    return _bits_set(*[F.col(f"{a}{n}").bitwiseXOR(F.col(f"{b}{n}")) for n in _BITS])


def _before(a: str, b: str) -> Column:
    """Line ``a`` stands before line ``b``."""
    return (F.col(f"{a}doc_id") < F.col(f"{b}doc_id")) | (
        (F.col(f"{a}doc_id") == F.col(f"{b}doc_id")) & (F.col(f"{a}line_no") < F.col(f"{b}line_no"))
    )


_OFFER = "struct<apart:int,y_doc_id:bigint,y_line_no:int>"
_PAIR = ("doc_id", "line_no", "y_doc_id", "y_line_no")


def _named(rows: DataFrame, start: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{start}{c}") if c in _ROW else F.col(c) for c in rows.columns])


def _token(key: Column, part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.xxhash64(key, part)).otherwise(key)


def _stored_rows(met: DataFrame, percent: int, split_lines: int) -> str:
    """Name of a stored table of the rows that share a key, bucketed by ``token``.

    A token is a key, or where that has very many lines the key and one of its ``parts``. ``best`` is the likeliest of
    three nearby lines (the first of the same token and size, the two before) that looks similar. Rows that have no
    line of a similar length beside them are left out. Joins on the token need no shuffle.
    """
    spark = met.sparkSession
    parts = F.ceil(F.col("n") / split_lines).cast("int")
    dealt = met.select("key", *_ROW, parts.alias("parts")).withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*_LINE), F.col("parts")).cast("int")).otherwise(0)
    )
    group = Window.partitionBy("key", "part", "size").orderBy(*_LINE)
    sizes = Window.partitionBy("key").orderBy("part", "size", *_LINE)
    row = F.struct(*_ROW)
    dealt = dealt.select("*", F.lag("size").over(sizes).alias("under"), F.lead("size").over(sizes).alias("over"))
    beside = [F.coalesce(_similar_length(percent, F.col(c), F.col("size")), F.lit(False)) for c in ("under", "over")]
    # a key that is dealt over parts may have its other lines elsewhere
    dealt = dealt.filter((F.col("parts") > 1) | beside[0] | beside[1]).drop("under", "over")
    near = dealt.select(
        "*", F.first(row).over(group).alias("f"), F.lag(row).over(group).alias("l"), F.lag(row, 2).over(group).alias("m")
    )
    flat = near.select(
        "key", "part", "parts", *_ROW, *[F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in "flm" for c in _ROW]
    )

    def offer(start: str) -> Column:
        fits = _before(start, "") & _may_match(percent, start, "")
        found = F.struct(_apart(start, ""), F.col(f"{start}doc_id"), F.col(f"{start}line_no")).cast(_OFFER)
        return F.when(fits, found)

    offers = [offer(f"{w}_") for w in "flm"]
    best = F.when(
        offers[0].isNotNull() | offers[1].isNotNull() | offers[2].isNotNull(),
        F.array_min(F.filter(F.array(*offers), lambda o: o.isNotNull())),
    )
    name = f"lines_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        (
            flat.select(
                _token(F.col("key"), F.col("part"), F.col("parts")).alias("token"),
                F.when(F.col("parts") > 1, F.col("key")).alias("key"),
                "part",
                "parts",
                *_ROW,
                best.alias("best"),
            )
            .write.option("path", _path_of(spark, name))
            .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
            .sortBy("token")
            .saveAsTable(name)
        )
    return name


def _path_of(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/llm-{name}"


def _dropped(spark: SparkSession, name: str) -> None:
    """Removes a table of ``_stored_rows``, its files included."""
    spark.sql(f"DROP TABLE {name}")
    remove_shared(spark, _path_of(spark, name))


def _pairs(rows: DataFrame, stored: DataFrame, percent: int, dealt: bool) -> DataFrame:
    """(doc_id, line_no, y_doc_id, y_line_no, apart): the earlier lines that may match, once for each common token of ``rows``.

    ``dealt`` tells whether any key is dealt over parts; its rows then visit them all.
    """
    others = _named(stored.select("token", *_ROW), "y_")
    fits = _before("y_", "") & _may_match(percent, "y_", "")
    met = rows.select("token", *_ROW).join(others, "token").filter(fits)
    if dealt:
        there = rows.filter("parts > 1").withColumn("home", F.col("part"))
        there = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> home")
        there = there.select(_token(F.col("key"), F.col("part"), F.col("parts")).alias("token"), *_ROW)
        met = met.unionByName(there.join(others, "token").filter(fits))
    return met.select(*_PAIR, _apart("y_", "").alias("apart"))


def _first_offers(keyed_lines: DataFrame, part: Column, percent: int, split_lines: int) -> DataFrame:
    """(doc_id, line_no, best): the likeliest earlier line of every line that may have one, by the keys of one pass."""
    spark = keyed_lines.sparkSession
    rows = _exploded(keyed_lines).filter(part)
    name = _stored_rows(_met(rows, percent), percent, split_lines)
    stored = spark.table(name)
    dealt = not stored.filter("parts > 1").isEmpty()
    plain = _pairs(stored.filter("best is null"), stored, percent, dealt)
    offers = plain.select(*_LINE, F.struct("apart", "y_doc_id", "y_line_no").cast(_OFFER).alias("best"))
    waiting = stored.filter("best is not null").select(*_LINE, "best")
    found = staged(offers.unionByName(waiting).groupBy(*_LINE).agg(F.min("best").alias("best")), "lines-offers")
    _dropped(spark, name)
    return found


def _all_pairs(keyed_lines: DataFrame, asked: DataFrame, percent: int, split_lines: int, slots: int) -> DataFrame:
    """(doc_id, line_no, y_doc_id, y_line_no): all earlier lines that the asked ones may match.

    Only rows are dealt out whose key a bitmap of the asked lines' keys lets through.
    """
    spark = keyed_lines.sparkSession
    # a few other lines that the bitmap lets through only take part in vain
    these = _members(staged(_hashed(asked, *_LINE), "lines-wanted"), slots)
    keys = keyed_lines.filter(_inside(F.xxhash64(*_LINE), these)).select(F.explode("keys").alias("key"))
    wanted = _members(staged(_hashed(keys, "key").distinct(), "lines-wanted"), slots)
    rows = _exploded(keyed_lines).filter(_inside(F.xxhash64(_key()), wanted))
    name = _stored_rows(_met(rows, percent), percent, split_lines)
    stored = spark.table(name)
    dealt = not stored.filter("parts > 1").isEmpty()
    pairs = _pairs(stored.join(asked, _LINE, "left_semi"), stored, percent, dealt)
    found = staged(pairs.select(*_PAIR).distinct(), "lines-pairs")
    _dropped(spark, name)
    return found


def _sketch_words(size: Column) -> Column:
    """Words of the sketch of a set: a power of two, more for larger sets."""
    wide = F.ceil(F.log2(F.greatest(size, F.lit(_WORD_TOKENS)) / _WORD_TOKENS)).cast("int")
    return F.least(F.call_function("shiftleft", F.lit(1), F.least(wide, F.lit(30))), F.lit(_MOST_WORDS))


def _sketch(high: Column, n: Column) -> Column:
    """Parities, in ``n`` words, of a set's hashes by bits that ``_BITS`` do not use. Both arguments are plain columns."""
    word = lambda j: F.filter(high, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(n - 1) == j)
    return F.when(n == 1, F.array(_flipped(high))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda j: _flipped(word(j))))


def _sketches_apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ, in as many words as the smaller has."""
    n = F.least(F.size(a), F.size(b))

    def folded(x: str) -> Column:
        every = lambda j: F.filter(x, lambda _, i: F.pmod(i, n) == j)
        one = lambda j: F.aggregate(every(j), F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(w))
        return F.when(F.size(x) == n, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))

    differing = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differing, F.lit(0), lambda acc, x: acc + x)


def _ends(pairs: DataFrame) -> DataFrame:
    others = pairs.select(F.col("y_doc_id").alias("doc_id"), F.col("y_line_no").alias("line_no"))
    return staged(_hashed(pairs.select(*_LINE).unionByName(others), *_LINE).distinct(), "lines-wanted")


def _both(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs with the other columns of ``lines`` for both ends, with y_ before those of the earlier line."""
    others = lines.select(*[F.col(c).alias(f"y_{c}") for c in lines.columns])
    return pairs.select(*_PAIR).join(lines, _LINE).join(others, ["y_doc_id", "y_line_no"])


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, min_words: int, slots: int) -> DataFrame:
    """(doc_id, line_no) of the later lines of pairs whose token sets are similar enough.

    The lines are cut out once. A bitmap that grows with their sets rules most other pairs out before any line is moved.
    """
    number = lambda t: F.xxhash64(t)
    wanted = _members(_ends(pairs), slots)
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = cut.filter(_inside(F.xxhash64(*_LINE), wanted)).select(*_LINE, F.trim(_spaced(F.lower("line"))).alias("line"))
    lines = lines.filter(_wordy(F.col("line"), min_words)).select(*_LINE, "line", once(words=_words(F.col("line"), number)))
    high = F.transform("words", lambda h: F.shiftrightunsigned(h, 32))
    told = lines.select(*_LINE, "line", once(high=high, size=F.size("words"), n=_sketch_words(F.size("words"))))
    sketched = told.select(*_LINE, "line", "size", _sketch(F.col("high"), F.col("n")).alias("sketch"))
    lines = staged(sketched, "lines-texts")
    few = _few_apart(percent, _sketches_apart("sketch", "y_sketch"), F.col("size") + F.col("y_size"))
    close = _both(pairs, lines.drop("line")).filter(few).select(*_PAIR).distinct()
    close = staged(close, "lines-close")
    needed = _members(_ends(close), slots)
    both = _both(close, lines.filter(_inside(F.xxhash64(*_LINE), needed)).select(*_LINE, "line"))
    sets = both.select(*_LINE, once(a=_words(F.col("line"), number), b=_words(F.col("y_line"), number))).select(
        *_LINE, once(n=F.size("a") + F.size("b"), shared=F.size(F.array_intersect("a", "b")))
    )
    return sets.filter(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent).select(*_LINE).distinct()


def removals(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    slots: int = SLOTS,
    split_lines: int = SPLIT_LINES,
) -> DataFrame:
    """(doc_id, lines): sorted numbers (from 0) of the lines to remove, for documents that lose any.

    Lines are parted by line feeds; tokens are lower-cased words between ASCII white space, those of a line form
    a set. Lines of fewer than ``min_words`` words are neither compared nor removed. Null texts have
    no lines; documents with a null id are left alone; rows that repeat a doc_id are one
    document. No documents give no rows. Other columns are ignored.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(
        "doc_id is not null and text is not null"
    )
    keyed = staged(_line_hashes(docs, min_words), "lines-keyed")
    copies = staged(_copies(keyed), "lines-copies")
    spark = docs.sparkSession
    keyed_lines = staged(_keyed_lines(_fresh(docs, keyed, copies, min_words, slots), percent), "lines-sets")
    n_keys = keyed_lines.agg(F.sum(F.size("keys"))).first()[0] or 0
    passes = min(PASSES, 1 + n_keys // PASS_KEYS)
    parts = [F.pmod(_key(), F.lit(passes)) == part for part in range(passes)]
    found = [_first_offers(keyed_lines, part, percent, split_lines) for part in parts]
    # one earlier line is enough, so the likeliest of all is tried first
    offers = reduce(DataFrame.unionByName, found).groupBy(*_LINE).agg(F.min("best").alias("best"))
    likeliest = staged(offers.select(*_LINE, "best.y_doc_id", "best.y_line_no"), "lines-likeliest")
    settled = staged(_confirmed(docs, likeliest, percent, min_words, slots), "lines-settled")
    # where it failed, all others that may match
    failed = staged(likeliest.select(*_LINE).join(settled, _LINE, "left_anti"), "lines-failed")
    if failed.isEmpty():
        more = likeliest.limit(0)
    else:
        more = _all_pairs(keyed_lines, failed, percent, split_lines, slots)
        more = staged(more.join(likeliest, [*_PAIR], "left_anti"), "lines-more")
    remove_shared(spark, keyed_lines)
    gone = settled.unionByName(copies)
    if not more.isEmpty():
        gone = gone.unionByName(_confirmed(docs, more, percent, min_words, slots))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))


def deduplicate(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    slots: int = SLOTS,
    split_lines: int = SPLIT_LINES,
) -> tuple[DataFrame, str, str]:
    """The rows of ``documents`` without the removed lines, and the names of two added columns.

    The first tells the number of removed lines, the second whether a line of ``min_words`` words is left. All other
    columns keep their names and values; see ``removals`` for what is removed.
    """
    names = documents.columns
    gone_name, id_name = free_name("gone", names), free_name("gone_id", names)
    n_name, left_name = free_name("n_removed", names), free_name("has_lines", names)
    gone = staged(removals(documents, doc_id, text, percent, min_words, slots, split_lines), "lines-gone")
    key = F.col(doc_id).cast("long")
    inside = key.isNotNull() & _inside(F.xxhash64(key), _members(_hashed(gone, "doc_id"), slots))
    named = gone.select(F.col("doc_id").alias(id_name), F.col("lines").alias(gone_name))
    touched = documents.filter(inside).join(named.hint("shuffle_hash"), key == F.col(id_name), "left")
    parts_name, kept_name = free_name("parts", names), free_name("kept_lines", names)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(F.col(parts_name)) - 1), F.col(gone_name))
    cut = touched.select(*names, gone_name, once(**{parts_name: F.split(F.col(text), "\n")})).select(
        *names, gone_name, once(**{kept_name: F.transform(numbers, lambda i: F.get(F.col(parts_name), i))})
    )
    is_gone = F.col(gone_name).isNotNull() & F.col(text).isNotNull()
    rebuilt = cut.select(
        *[(F.when(is_gone, F.array_join(kept_name, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c)) for c in names],
        F.when(is_gone, F.size(F.col(gone_name))).otherwise(0).alias(n_name),
        F.when(is_gone, F.exists(kept_name, lambda x: _wordy(F.trim(_spaced(F.lower(x))), min_words))).otherwise(True).alias(left_name),
    )
    untouched = documents.filter(~inside).select(
        *names, F.lit(0).alias(n_name), F.lit(True).alias(left_name)
    )
    return rebuilt.unionByName(untouched), n_name, left_name
