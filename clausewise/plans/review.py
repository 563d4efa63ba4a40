"""Contract review from text to analysis tables.

The model is outside: ``prepare`` writes what it has to answer, ``finish`` reads what it
said.  Both are set-oriented, so one run covers every contract at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.functions.text import computed
from clausewise.operators import analysis, clauses, exchange, keywords, parties, rollups, rules
from clausewise.operators.bm25 import Bm25Index
from clausewise.operators.vectors import as_batches
from clausewise.plans.retrieval import clause_retrieval, item_queries
from clausewise.session import write_shared
from clausewise.sources import contracts as door
from clausewise.sources import stores

FACTS = ["filename", "contract_type", "sub_type", "party_a", "party_b"]


@dataclass(frozen=True)
class Prepared:
    contracts: DataFrame
    ruled: DataFrame
    hits: DataFrame | None
    requests: DataFrame


def detect(contracts: DataFrame) -> DataFrame:
    """Add contract type, lease sub-type and party roles."""
    typed = contracts.select("*", computed(contract_type=keywords.contract_type(F.col("text"))))
    sub_type = F.when(F.col("contract_type") == "lease", keywords.lease_subtype(F.col("text")))
    facts = typed.select("*", computed(sub_type=sub_type, _p=parties.parties(F.col("text"), F.col("contract_type"))))
    return facts.select("*", "_p.*").drop("_p")


def split_and_rule(contracts: DataFrame) -> DataFrame:
    """Clauses with their rule verdicts.  Row-local, so it also runs on a stream."""
    split = clauses.split_clauses(contracts, keep=FACTS)
    return rules.apply_rules(split)


def prepare(
    contracts: DataFrame,
    kb: DataFrame | None = None,
    index: Bm25Index | None = None,
    k: int = fv.TOP_K,
    kb_vectors: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
    vectoriser: Callable | None = None,
    **options,
) -> Prepared:
    """Everything up to the request table.

    With ``kb_vectors(id, embedding)`` clauses are searched by both retrievers; the vectors of their items come from
    ``item_vectors(query_id, embedding)`` or from ``vectoriser(list of texts) -> 2-d array``.
    """
    detected = detect(door.accepted(contracts))
    # clauses and rule verdicts feed the search, the requests and the final join
    ruled = write_shared(split_and_rule(detected), "ruled-clauses")
    open_clauses = rules.unresolved(ruled)
    if kb is None or index is None:
        hits = None
        references = open_clauses.select(*exchange.KEYS, F.lit(None).cast("string").alias("reference_text"))
    else:
        if item_vectors is None and vectoriser is not None and kb_vectors is not None:
            texts = item_queries(open_clauses, exchange.KEYS).select(F.col("query_id").alias("id"), "text")
            made = texts.mapInPandas(as_batches(vectoriser), "id string, embedding array<float>")
            item_vectors = made.withColumnRenamed("id", "query_id")
        found = clause_retrieval(open_clauses, exchange.KEYS, kb, index, k, item_vectors, kb_vectors, **options)
        optional = [c for c in ("article",) if c in kb.columns]
        hits = found.join(kb.select("id", "text", *optional), "id").withColumn("pos", F.col("merged_pos"))
        if not optional:
            hits = hits.withColumn("article", F.lit(None).cast("string"))
        references = exchange.reference_texts(hits)
    return Prepared(detected, ruled, hits, exchange.model_requests(open_clauses, references))


def verdicts(ruled: DataFrame, best: DataFrame) -> DataFrame:
    """Rule verdicts and folded model verdicts of all clauses from the ``best_attempts`` of the model."""
    return exchange.all_verdicts(
        rules.rule_verdicts(ruled), exchange.fold_responses(rules.unresolved(ruled), best)
    )


def finish(
    prepared: Prepared,
    responses: DataFrame,
    rewrite_responses: DataFrame | None = None,
    overrides: DataFrame | None = None,
    quarantine_path: str | None = None,
) -> DataFrame:
    """Clause analyses of every contract; answers that could not be read are appended to ``quarantine_path``."""
    best = exchange.best_attempts(exchange.parse_responses(responses))
    if quarantine_path is not None:
        best = write_shared(best, "best-attempts")  # answers are read once for both uses
        stores.write_quarantine(exchange.quarantine(best), quarantine_path)
    base = prepared.ruled.select(*exchange.KEYS, "clause_index", "title", "content", "contract_type")
    out = analysis.attach_verdicts(base, verdicts(prepared.ruled, best))
    out = analysis.normalize_risk_types(out)
    if prepared.hits is not None:
        out = analysis.attach_references(out, analysis.reference_details(prepared.hits))
    if rewrite_responses is not None:
        fixed = exchange.rewrites(rewrite_responses)
        out = out.join(fixed, exchange.KEYS, "left").withColumn(
            "suggested_rewrite", F.when(R.needs_rewrite(F.col("risk_level")), F.col("suggested_rewrite"))
        )
    else:
        out = out.withColumn("suggested_rewrite", F.lit(None).cast("string"))
    if overrides is not None:
        out = out.join(overrides, exchange.KEYS, "left")
    else:
        out = out.withColumn("user_override", F.lit(None).cast("string")).withColumn(
            "user_override_at", F.lit(None).cast("string")
        )
    return out


def headers(prepared: Prepared, analyses: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per contract: file, totals and summary."""
    totals = rollups.contract_totals(analyses)
    distribution = rollups.risk_distribution(analyses)
    said = summaries if summaries is not None else distribution.select(
        "document_id", F.lit(None).cast("string").alias("raw_text"), F.lit("empty").alias("status")
    )
    return (
        totals.join(prepared.contracts.select("document_id", *FACTS), "document_id")
        .join(rollups.choose_summary(distribution, said), "document_id")
    )
