"""BM25 index and search as tables.

Documents count a term once (tokens are distinct), so the score of a document is
``norm(length) * sum(idf of the query terms it contains)``.

A query of one contract type searches that type and the common rows, a query without a
type searches everything.  Postings are stored once, on the shelf of their own type;
statistics of an index are added up from its shelves, so common rows are never copied.

* ``postings(shelf, term, step, id, dl)``; documents of one length step are a block of each list
* ``terms(contract_type, term, df, idf)``, one row per index and term
* ``stats(contract_type, n_docs, avgdl)``, one row per index
* ``blocks(contract_type, term, step, n, min_dl, max_dl)``, where a search is to leave blocks out

Counts by shelf, term and step, and sizes by shelf, may be added up over parts of a
knowledge base; everything else follows from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions.scoring import bm25_similarity, length_norm
from clausewise.functions.text import computed, tokenize
from clausewise.operators.skew import hot_keys, salted_join, top_n
from clausewise.session import write_shared

COMMON = "common"
WHOLE = "*"  # index over every document, used by queries without a type
OTHER = "-"  # shelf of rows whose type has no index of its own
LENGTH_STEPS = [8, 16, 32, 64, 128, 256, 512, 1024, 4096]
# query rows small enough to send to every executor (about 100 bytes each)
BROADCAST_ROWS = 200_000
# distinct query terms that are named in a filter of the stored postings; more are joined without one
PUSHED_TERMS = 1_000
# postings that one task sorts or counts, and query terms found in documents that one task adds up
POSTINGS_PER_TASK = 2_000_000
MATCHES_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    types: tuple[str, ...]
    blocks: DataFrame | None = None
    stored: bool = False
    docs: DataFrame | None = None  # (id, shelf, tokens, dl), where documents can be read whole


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def indexes_of(shelf: Column, types: list[str], whole: bool = True) -> Column:
    """Indexes a shelf belongs to: its own type, every type for common, and the whole."""
    every = [WHOLE] if whole else []
    out = F.when(shelf == COMMON, _strings([*types, *every])).otherwise(_strings(every))
    for ct in types:
        out = F.when(shelf == ct, _strings([ct, *every])).otherwise(out)
    return out


def shelves_of(index: Column, types: list[str]) -> Column:
    """Shelves an index reads."""
    return F.when(index == WHOLE, _strings([*types, COMMON, OTHER])).otherwise(F.array(index, F.lit(COMMON)))


def shelf_of(contract_type: Column, types: list[str]) -> Column:
    return F.when(contract_type.isin([*types, COMMON]), contract_type).otherwise(OTHER)


def replicate_common(kb: DataFrame, types: list[str] | None = None, whole: bool = False) -> DataFrame:
    """One row per index a KB row belongs to; common rows go to every type."""
    known = dims.contract_types() if types is None else types
    return kb.withColumn("contract_type", F.explode(indexes_of(shelf_of(F.col("contract_type"), known), known, whole)))


def kb_types(kb: DataFrame) -> DataFrame:
    """Contract types present in the KB, common excluded."""
    return kb.filter(F.col("contract_type") != COMMON).select("contract_type").distinct()


def document_terms(kb: DataFrame, particles: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(id, shelf, distinct tokens, their number): one row per document."""
    known = dims.contract_types() if types is None else types
    shelf = shelf_of(F.col("contract_type"), known).alias("shelf")
    tokens = kb.select("id", shelf, tokenize(F.col("text"), particles).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens"))


def step_of(length: Column) -> Column:
    """Place of a document in the blocks of its lists: the number of length steps it exceeds."""
    return sum(((length > s).cast("int") for s in LENGTH_STEPS[1:]), (length > LENGTH_STEPS[0]).cast("int"))


def postings_of(docs: DataFrame) -> DataFrame:
    """(shelf, term, step, id, dl) of ``document_terms``."""
    return docs.select("shelf", F.explode("tokens").alias("term"), step_of(F.col("dl")).alias("step"), "id", "dl")


def tasks_for(docs: DataFrame) -> int:
    """Tasks that the postings of stored ``docs`` are dealt over; only the lengths are read for it."""
    total = docs.agg(F.sum("dl")).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / POSTINGS_PER_TASK))


def dealt(docs: DataFrame) -> DataFrame:
    """Stored ``docs`` in pieces of bounded work: a split of a compressed file may hold very many postings."""
    tasks = tasks_for(docs)
    return docs.repartition(tasks, "id") if tasks > docs.sparkSession.sparkContext.defaultParallelism else docs


def block_counts(docs: DataFrame) -> DataFrame:
    """(shelf, term, step, n, min_dl, max_dl): counts that may be added up over parts of a shelf."""
    return (
        postings_of(docs)
        .groupBy("shelf", "term", "step")
        .agg(F.count("*").alias("n"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"))
    )


def shelf_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("shelf").agg(F.count("*").alias("n"), F.sum("dl").alias("length"))


def statistics(sizes: DataFrame, known: list[str], whole: bool = True) -> DataFrame:
    """(contract_type, n_docs, avgdl) of every index from the sizes of its shelves."""
    return (
        sizes.select("n", "length", F.explode(indexes_of(F.col("shelf"), known, whole)).alias("contract_type"))
        .groupBy("contract_type")
        .agg(F.sum("n").alias("n_docs"), (F.sum("length") / F.sum("n")).alias("avgdl"))
    )


def index_blocks(counts: DataFrame, known: list[str], whole: bool = True) -> DataFrame:
    """(contract_type, term, step, n, min_dl, max_dl) of every index from the counts of its shelves."""
    return (
        counts.withColumn("contract_type", F.explode(indexes_of(F.col("shelf"), known, whole)))
        .groupBy("contract_type", "term", "step")
        .agg(F.sum("n").alias("n"), F.min("min_dl").alias("min_dl"), F.max("max_dl").alias("max_dl"))
    )


def weigh(
    frequencies: DataFrame, stats: DataFrame, epsilon: float = fv.BM25_EPSILON, materialize: bool = True
) -> DataFrame:
    """(contract_type, term, df, idf); a negative idf becomes ``epsilon`` times the mean of its index.

    The mean and the weights both read the frequencies, so these are counted once and written to the shared folder.
    """
    n, df = F.col("n_docs"), F.col("df")
    raw = frequencies.join(F.broadcast(stats), "contract_type").select(
        "contract_type", "term", "df", (F.log(n - df + 0.5) - F.log(df + 0.5)).alias("raw_idf")
    )
    if materialize:
        raw = write_shared(raw, "index-terms")
    mean = raw.groupBy("contract_type").agg((F.avg("raw_idf") * epsilon).alias("floor"))
    return raw.join(F.broadcast(mean), "contract_type").select(
        "contract_type", "term", "df", F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf")).alias("idf")
    )


def build_index(
    kb: DataFrame,
    particles: list[str] | None = None,
    types: list[str] | None = None,
    whole: bool = True,
    epsilon: float = fv.BM25_EPSILON,
    blocks: bool = False,
    materialize: bool = True,
) -> Bm25Index:
    """Index of ``kb(id, text, contract_type)``.

    Tokens are extracted once and written to the shared folder, because statistics and
    postings both read them.  ``types`` may be fewer than the supported ones.
    ``blocks`` adds the bounds of every block of a list, by which a search leaves out
    blocks that cannot matter; worth it for an index that is stored.
    """
    known = dims.contract_types() if types is None else types
    docs = document_terms(kb, particles, known)
    if materialize:
        docs = write_shared(docs, "document-terms")
    stats = statistics(shelf_sizes(docs), known, whole)
    pieces = dealt(docs) if materialize else docs
    bounds = None
    if blocks:
        bounds = index_blocks(block_counts(pieces), known, whole)
        if materialize:
            bounds = write_shared(bounds, "index-blocks")
        frequencies = bounds.groupBy("contract_type", "term").agg(F.sum("n").alias("df"))
    else:
        frequencies = (
            postings_of(pieces)
            .groupBy("shelf", "term")
            .agg(F.count("*").alias("df"))
            .withColumn("contract_type", F.explode(indexes_of(F.col("shelf"), known, whole)))
            .groupBy("contract_type", "term")
            .agg(F.sum("df").alias("df"))
        )
    terms = weigh(frequencies, stats, epsilon, materialize)
    return Bm25Index(postings_of(docs), terms, stats, tuple(known), bounds, docs=docs if materialize else None)


def query_terms(queries: DataFrame, particles: list[str] | None = None) -> DataFrame:
    """(query_id, contract_type, term) of ``queries(query_id, text, contract_type)``."""
    return queries.select(
        "query_id",
        F.coalesce("contract_type", F.lit(WHOLE)).alias("contract_type"),
        F.explode(tokenize(F.col("text"), particles)).alias("term"),
    )


def only_terms(index: Bm25Index, asked: DataFrame) -> Bm25Index:
    """The index with a filter on the asked terms, which reaches the scan of a stored one; for few terms only."""
    named = asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
    if len(named) > PUSHED_TERMS:
        return index
    wanted = F.col("term").isin([r["term"] for r in named])
    blocks = None if index.blocks is None else index.blocks.filter(wanted)
    return replace(index, postings=index.postings.filter(wanted), terms=index.terms.filter(wanted), blocks=blocks)


def _weights(index: Bm25Index, asked: DataFrame, small: bool) -> DataFrame:
    """Query terms with their idf and the statistics of their index."""
    side = F.broadcast(asked) if small else asked
    known = index.terms.join(side, ["contract_type", "term"])
    return known.join(F.broadcast(index.stats), "contract_type")


def _score(k1: float, b: float) -> Column:
    return F.col("idf") * length_norm(F.col("dl"), F.col("avgdl"), k1, b)


def _lists(index: Bm25Index, weighted: DataFrame, small: bool) -> DataFrame:
    """Posting lists of the query terms, or only the blocks of them that ``weighted`` names by their step.

    Hot terms are spread over salts.
    """
    shelves = shelves_of(F.col("contract_type"), list(index.types))
    by_block = "step" in weighted.columns
    keys = ["shelf", "term", "step"] if by_block else ["shelf", "term"]
    wanted = weighted.select(F.explode(shelves).alias("shelf"), *keys[1:], "query_id", "idf", "avgdl")
    if small:
        return index.postings.join(F.broadcast(wanted), keys)
    # a list is at most as long as the term's list over the whole index
    counts = index.blocks.withColumnRenamed("n", "df") if by_block else index.terms
    hot = (
        hot_keys(counts, ["contract_type", *keys[1:]], "df")
        .select(F.explode(shelves).alias("shelf"), *keys[1:], "_salts")
        .groupBy(*keys)
        .agg(F.max("_salts").alias("_salts"))
    )
    return salted_join(index.postings, wanted, keys, hot, ["id"])


def query_postings(queries: DataFrame, index: Bm25Index, particles: list[str] | None = None) -> DataFrame:
    """(query_id, term, id, idf, dl, ...): every posting that a query's terms reach."""
    return _lists(index, _weights(index, query_terms(queries, particles), False), False)


def _by_document(index: Bm25Index, weighted: DataFrame) -> Bm25Index:
    """The index with its postings dealt by document, over as many tasks as the query terms found in documents ask for.

    A list in the order of terms brings the commonest terms of many queries into one task, which would hold a
    score of each query for all documents. Dealt by document the scores of a task are bounded, and final
    there. Where a stored index is asked for little, its lists are read as they lie, by the terms named in the scan.
    """
    matches = weighted.agg(F.sum("n" if "step" in weighted.columns else "df")).first()[0] or 0
    if index.stored and matches <= MATCHES_PER_TASK:
        return index
    tasks = math.ceil(matches / MATCHES_PER_TASK)
    if index.docs is None:
        tasks = max(tasks, index.postings.sparkSession.sparkContext.defaultParallelism)
        return replace(index, postings=index.postings.repartition(tasks, "id"))
    return replace(index, postings=postings_of(index.docs.repartition(max(tasks, tasks_for(index.docs)), "id")))


def _rank(scored: DataFrame, k: int) -> DataFrame:
    rounded = scored.select("query_id", "id", F.round("score", 6).alias("score")).filter(F.col("score") > 0)
    return top_n(rounded, ["query_id"], [F.desc("score"), F.asc("id")], k)


def search(
    queries: DataFrame,
    index: Bm25Index,
    k: int = fv.TOP_K,
    particles: list[str] | None = None,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    strategy: str = "auto",
) -> DataFrame:
    """Top-k documents per query: (query_id, id, score, similarity, pos).

    * ``broadcast``: the query terms go to every executor and the posting lists never
      move.  Chosen when the measured number of query terms is small.
    * ``pruned``: both sides are shuffled, hot terms salted.

    Both are exact.  With the bounds of an index built with ``blocks``, blocks that cannot
    lift a document into the top k are only looked up for documents that still can get
    there.  Ties are broken by id.
    """
    asked = query_terms(queries, particles)
    if strategy == "auto":
        rows = asked.limit(BROADCAST_ROWS + 1).count()
        strategy = "pruned" if rows > BROADCAST_ROWS else "broadcast"
        if index.stored and rows <= 10 * PUSHED_TERMS:
            index = only_terms(index, asked)
    small = strategy == "broadcast"
    weighted = _weights(index, asked, small)
    if index.blocks is None:
        found = _lists(_by_document(index, weighted), weighted, small)
        scored = found.groupBy("query_id", "id").agg(F.sum(_score(k1, b)).alias("score"))
    else:
        scored = _pruned_scores(index, weighted, k, k1, b, small)
    return _rank(scored, k).withColumn("similarity", bm25_similarity(F.col("score")))


def block_bounds(index: Bm25Index, weighted: DataFrame, k: int, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
    """Blocks of the lists of each query with ``optional``, and by query and step what optional blocks may add or take.

    The shortest documents of a list prove a lowest score for the k-th hit.  All blocks of a document
    are of one step, so the best its optional blocks can add is their sum over that step; where this
    is less than the proven score, a document found only there cannot qualify.
    """
    slack = 1e-5  # covers rounding of scores before ranking
    listed = weighted.join(index.blocks, ["contract_type", "term"])
    term = Window.partitionBy("query_id", "term")
    whole = Window.partitionBy("query_id")
    step = Window.partitionBy("query_id", "step")
    rising = step.orderBy("upper", "term").rowsBetween(Window.unboundedPreceding, 0)
    best = F.col("idf") * length_norm(F.col("min_dl"), F.col("avgdl"), k1, b)
    reached = F.sum("n").over(term.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)) >= k
    proven = F.when((F.col("idf") > 0) & F.col("reached"), F.col("idf") * length_norm(F.col("max_dl"), F.col("avgdl"), k1, b))
    first = F.col("step") == F.min("step").over(term)
    optional = F.coalesce(F.col("reach") < F.col("limit") - slack, F.lit(False))
    return (
        listed.withColumn("reached", reached)
        .withColumn("upper", F.greatest(F.lit(0.0), best))
        .withColumn("lower", F.least(F.lit(0.0), best))
        # the first step of a term holds its shortest documents, where a negative weight takes most
        .withColumn("worst", F.when(first, F.col("lower")).otherwise(0.0))
        .withColumn("limit", F.max(proven).over(whole) + F.sum("worst").over(whole))
        .withColumn("reach", F.sum("upper").over(rising))
        .withColumn("optional", optional)
        .withColumn("gain", F.sum(F.when(F.col("optional"), F.col("upper")).otherwise(0.0)).over(step))
        .withColumn("loss", F.sum(F.when(F.col("optional"), F.col("lower")).otherwise(0.0)).over(step))
    )


def _posted(index: Bm25Index, within: DataFrame, rest: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of the postings of candidates in optional blocks."""
    shelves = shelves_of(F.col("contract_type"), list(index.types))
    wanted = rest.select("query_id", "step", F.explode(shelves).alias("shelf"), "term", "idf", "avgdl")
    return (
        within.join(wanted, ["query_id", "step"])
        .join(index.postings, ["shelf", "term", "step", "id"])
        .select("query_id", "id", _score(k1, b).alias("score"))
    )


def _held(index: Bm25Index, within: DataFrame, rest: DataFrame, k1: float, b: float) -> DataFrame:
    """As ``_posted``, from the candidates' own documents: candidates are few, and no list is sorted to find them.

    The optional terms of a query and step lie in one array, which is at most as long as the query.
    """
    wanted = rest.groupBy("query_id", "step").agg(
        F.collect_list(F.struct("contract_type", "term", "idf", "avgdl")).alias("wanted")
    )
    docs = index.docs
    if within.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(within.select("id").distinct()), "id", "left_semi")
    docs = docs.select("id", "shelf", "tokens", "dl", step_of(F.col("dl")).alias("step"))
    met = within.select("query_id", "step", "id").join(wanted, ["query_id", "step"]).join(docs, ["id", "step"])
    # the terms both have are found once for each candidate
    shared = met.select(
        "query_id", "id", "shelf", "dl", "wanted",
        computed(shared=F.array_intersect(F.transform("wanted", lambda w: w["term"]), F.col("tokens"))),
    )

    def add(total: Column, w: Column) -> Column:
        # the shelves an index reads, see shelves_of
        read = (w["contract_type"] == WHOLE) | (F.col("shelf") == COMMON) | (w["contract_type"] == F.col("shelf"))
        found = read & F.array_contains("shared", w["term"])
        return total + F.when(found, w["idf"] * length_norm(F.col("dl"), w["avgdl"], k1, b)).otherwise(0.0)

    return shared.select("query_id", "id", F.aggregate("wanted", F.lit(0.0), add).alias("score"))


def _pruned_scores(index: Bm25Index, weighted: DataFrame, k: int, k1: float, b: float, small: bool) -> DataFrame:
    """Exact scores of every document that can be among the best k of its query.

    Scores from the blocks that are not optional give a tighter limit, and only documents
    within reach of it are completed.
    """
    slack = 1e-5
    bounded = write_shared(block_bounds(index, weighted, k, k1, b), "query-blocks")
    needed = bounded.filter(~F.col("optional"))
    partial = (
        _lists(_by_document(index, needed), needed, small)
        .groupBy("query_id", "id")
        .agg(F.sum(_score(k1, b)).alias("score"), F.max("step").alias("step"))
    )
    partial = write_shared(partial, "partial-scores")
    by_step = bounded.groupBy("query_id", "step").agg(F.max("gain").alias("gain"), F.min("loss").alias("loss"))
    kth = (
        top_n(partial, ["query_id"], [F.desc("score")], k)
        .groupBy("query_id")
        .agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        .join(by_step.groupBy("query_id").agg(F.min("loss").alias("loss")), "query_id")
    )
    within = (
        partial.join(kth, "query_id")
        .join(by_step.select("query_id", "step", "gain"), ["query_id", "step"])
        .filter(F.col("kth").isNull() | (F.col("score") + F.col("gain") >= F.col("kth") + F.col("loss") - slack))
    )
    within = write_shared(within.select("query_id", "step", "id", "score"), "candidates")
    rest = bounded.filter("optional")
    look_up = _posted if index.docs is None else _held
    completed = look_up(index, within, rest, k1, b)
    return (
        within.select("query_id", "id", "score")
        .unionByName(completed)
        .groupBy("query_id", "id")
        .agg(F.sum("score").alias("score"))
    )
