"""Clause analyses: verdicts, references, rewrites and overrides joined to clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.functions.text import blank_to_null, computed, lookup, reference_line, strip
from clausewise.functions.udfs import match_ratio
from clausewise.operators.exchange import KEYS
from clausewise.operators.fusion import report_category
from clausewise.session import write_shared


def attach_verdicts(clauses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every clause with its verdict; a clause nothing was said about is medium, 'missing'."""
    fields = ["risk_level", "confidence", "risks", "explanation", "analysis_status"]
    joined = clauses.join(verdicts.select(*KEYS, *fields, F.lit(True).alias("_known")).hint("merge"), KEYS, "left")
    known = F.col("_known").isNotNull()
    return (
        joined.withColumn("risk_level", F.when(known, R.risk_level(F.coalesce("risk_level", F.lit("safe")))).otherwise("medium"))
        .withColumn("confidence", F.when(known, F.coalesce("confidence", F.lit(fv.DEFAULT_CONFIDENCE))).otherwise(fv.FAILURE_CONFIDENCE))
        .withColumn("risks", F.coalesce("risks", F.array().cast(f"array<{R.RISK.simpleString()}>")))
        .withColumn("explanation", F.when(known, F.coalesce("explanation", F.lit(""))).otherwise(fv.MISSING_EXPLANATION))
        .withColumn("analysis_status", F.when(known, F.coalesce("analysis_status", F.lit("ok"))).otherwise("missing"))
        .drop("_known")
    )


def risk_type_map(
    raw_types: DataFrame, valid: DataFrame | None = None, min_ratio: float = fv.MIN_RISK_TYPE_SIMILARITY
) -> DataFrame:
    """(contract_type, raw, risk_type) of distinct raw names.

    Names are compared with the valid ones of their type: exact names stay, near ones are replaced by the
    most similar (of equal ones that with the lowest ``ord``), the rest is kept, trimmed. Without any valid names of the type
    the raw name is not even trimmed.

    The default names are a fixed dimension, a few for each type, and every pair is compared. A ``valid``
    table (contract_type, ord, risk_type) may have any size: see ``_similar_names``.
    """
    names = raw_types.select("contract_type", strip(F.col("raw")).alias("name"), "raw").distinct()
    if valid is None:
        fixed = dims.risk_type_dim(raw_types.sparkSession).withColumnRenamed("risk_type", "valid")
        scored = names.join(F.broadcast(fixed), "contract_type", "left")
        scored = scored.withColumn(
            "ratio", F.when(F.col("name") == F.col("valid"), F.lit(2.0)).otherwise(match_ratio("name", "valid"))
        )
        best = scored.groupBy("contract_type", "raw", "name").agg(
            F.max(F.struct("ratio", (-F.col("ord")).alias("first"), "valid")).alias("best")
        )
        known = F.col("best.valid").isNotNull()
    else:
        listed = valid.select("contract_type", "ord", F.col("risk_type").alias("valid")).filter("valid is not null")
        types = listed.groupBy("contract_type").agg(F.max(F.length("valid")).alias("longest"))
        typed = write_shared(names.join(types, "contract_type", "left"), "risk-names")
        found = _similar_names(typed.select("contract_type", "name", "longest").distinct(), listed, min_ratio)
        best = typed.join(found, ["contract_type", "name"], "left")
        known = F.col("longest").isNotNull()
    mapped = F.when(~known, F.col("raw")).when(F.col("best.ratio") >= min_ratio, F.col("best.valid")).otherwise(F.col("name"))
    return best.select("contract_type", "raw", mapped.alias("risk_type"))


_SLACK = 1e-9


def _numbered(name: str) -> Column:
    """The characters of a name, each with the number of its occurrence, so that the array is a set.

    In the sorted name that is the character's place less the place where it first occurs.
    """
    plain = F.array_sort(F.split(F.col(name), ""))
    return F.transform(plain, lambda c, at: F.concat(c, F.lit("\u0001"), (at + 1 - F.array_position(plain, c)).cast("string")))


def _similar_names(names: DataFrame, listed: DataFrame, min_ratio: float) -> DataFrame:
    """(contract_type, name, best): the most similar listed name of at least ``min_ratio``, for names that have one.

    Matching blocks hold no more than the characters two names share, so twice the shared number over both lengths bounds the
    ratio. Pairs that may reach ``min_ratio`` come from a prefix join: with characters in one order, from rare to
    common, such a pair shares one of its first few. The pair with the highest bound is compared first, then only those
    whose bound is no lower than its ratio.
    """
    if min_ratio <= 0:
        raise ValueError("min_ratio must be above 0")
    key = ["contract_type", "name"]
    exact = names.join(
        listed.select("contract_type", F.col("valid").alias("name"), "ord"), key
    ).groupBy(*key).agg(F.max(F.struct(F.lit(2.0).alias("ratio"), (-F.col("ord")).alias("first"), F.col("name").alias("valid"))).alias("best"))
    exact = write_shared(exact, "risk-exact")
    share = min_ratio / (2 - min_ratio)
    # longer names can't reach the ratio with any listed one
    open_names = names.join(exact, key, "left_anti").filter(F.length("name") * share <= F.col("longest") + _SLACK)
    left = open_names.filter("name <> ''").select(*key, computed(chars=_numbered("name")))
    right = listed.filter("valid <> ''").select("contract_type", "ord", "valid", computed(chars=_numbered("valid")))
    common = write_shared(
        right.select("contract_type", F.explode("chars").alias("c")).groupBy("contract_type", "c").agg(F.count("*").alias("n")),
        "risk-characters",
    )

    def prefixes(side: DataFrame, of: list[str]) -> DataFrame:
        marks = side.select("contract_type", *of, F.explode("chars").alias("c")).join(common, ["contract_type", "c"], "left")
        # names are short, and what is gathered is one name
        ordered = marks.groupBy("contract_type", *of).agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "c"))).alias("marks")
        )
        least = F.greatest(F.lit(1), F.ceil(F.size("marks") * share - _SLACK).cast("int"))
        chars = F.transform("marks", lambda m: m["c"])
        return ordered.select("contract_type", *of, chars.alias("chars"), (F.size("marks") - least + 1).alias("length")).select(
            "contract_type", *of, "chars", F.explode(F.slice("chars", 1, F.col("length"))).alias("c")
        )

    ours = prefixes(left, ["name"])
    theirs = prefixes(right, ["ord", "valid"]).withColumnRenamed("chars", "other")
    n, m = F.size("chars"), F.size("other")
    bound = F.size(F.array_intersect("chars", "other")) * 2.0 / (n + m)
    fits = (F.least(n, m) * 2.0 / (n + m)) >= min_ratio - _SLACK
    pairs = (
        ours.join(theirs, ["contract_type", "c"])
        .filter(fits)
        .select(*key, "ord", "valid", bound.alias("bound"))
        .filter(F.col("bound") >= min_ratio - _SLACK)
        .distinct()
    )
    pairs = write_shared(pairs, "risk-pairs")

    def judged(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.struct(match_ratio("name", "valid").alias("ratio"), (-F.col("ord")).alias("first"), "valid").alias("best"))

    likeliest = pairs.groupBy(*key).agg(F.max(F.struct("bound", (-F.col("ord")).alias("first"), "valid")).alias("top"))
    tried = write_shared(judged(likeliest.select(*key, (-F.col("top.first")).alias("ord"), "top.valid")), "risk-tried")
    rest = pairs.join(tried, key).filter(
        (F.col("bound") >= F.col("best.ratio")) & ((F.col("valid") != F.col("best.valid")) | (-F.col("ord") != F.col("best.first")))
    )
    all_judged = tried.unionByName(judged(rest.select(*key, "ord", "valid"))).groupBy(*key).agg(F.max("best").alias("best"))
    return exact.unionByName(all_judged.filter(F.col("best.ratio") >= min_ratio))


def normalize_risk_types(analyses: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Replace raw risk types inside ``risks`` by the valid ones of the contract type."""
    plain = analyses.withColumn("_id", F.struct(*KEYS))
    exploded = plain.select(
        "_id", "contract_type", F.posexplode("risks").alias("at", "risk")
    ).withColumn("raw", F.coalesce("risk.risk_type", F.lit("unknown")))
    mapping = risk_type_map(exploded.select("contract_type", "raw"), valid)
    renamed = exploded.join(mapping, ["contract_type", "raw"]).select(
        "_id",
        F.struct(
            "at",
            F.struct(
                "risk_type",
                F.coalesce("risk.description", F.lit("")).alias("description"),
                F.coalesce("risk.suggestion", F.lit("")).alias("suggestion"),
            ).alias("risk"),
        ).alias("row"),
    )
    # risks of one clause come from one response, so the group is small by nature
    gathered = renamed.groupBy("_id").agg(F.array_sort(F.collect_list("row")).alias("_rows"))
    return (
        plain.join(gathered, "_id", "left")
        .withColumn(
            "risks",
            F.coalesce(
                F.transform("_rows", lambda r: r["risk"]), F.array().cast(f"array<{R.RISK.simpleString()}>")
            ),
        )
        .drop("_id", "_rows")
    )


def reference_details(hits: DataFrame) -> DataFrame:
    """Hit rows as reported references: category, display line, article."""
    return hits.select(
        *KEYS,
        "pos",
        "text",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        report_category(F.coalesce("source", F.lit(""))).alias("category"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.nullif("article", F.lit("")).alias("article"),
        reference_line(F.col("text"), F.coalesce("similarity", F.lit(0.0))).alias("line"),
    )


def attach_references(clauses: DataFrame, details: DataFrame) -> DataFrame:
    """Clauses with their references as arrays ordered by similarity.

    A clause has at most k hits per item, so the gathered group is small by nature.
    """
    rows = details.groupBy(*KEYS).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("similarity")).alias("by"), "pos", "text", "source", "category", "similarity", "article", "line"
                )
            )
        ).alias("_refs")
    )
    empty = F.array()
    item = "array<struct<text:string,source:string,category:string,similarity:double,article:string>>"
    return (
        clauses.join(rows.hint("merge"), KEYS, "left")
        .withColumn(
            "similar_references",
            F.coalesce(F.transform("_refs", lambda r: r["line"]), empty.cast("array<string>")),
        )
        .withColumn(
            "references_detail",
            F.coalesce(
                F.transform(
                    "_refs",
                    lambda r: F.struct(r["text"], r["source"], r["category"], r["similarity"], r["article"]),
                ).cast(item),
                empty.cast(item),
            ),
        )
        .drop("_refs")
    )


def final_text(rewrite: Column, override: Column) -> Column:
    """``struct<text, label>``: the user's text, else the model's, else nulls."""
    user, model = blank_to_null(override), blank_to_null(rewrite)
    return F.struct(
        F.coalesce(user, model).alias("text"),
        F.when(user.isNotNull(), fv.USER_REWRITE_LABEL)
        .when(model.isNotNull(), fv.MODEL_REWRITE_LABEL)
        .otherwise("")
        .alias("label"),
    )


def attach_rewrites(analyses: DataFrame, rewrites: DataFrame, overrides: DataFrame) -> DataFrame:
    return analyses.join(rewrites, KEYS, "left").join(overrides, KEYS, "left")


def risk_label(level: Column) -> Column:
    return lookup(level, fv.RISK_LABELS, level)


def badge_label(level: Column) -> Column:
    return lookup(level, fv.RISK_LABELS, F.lit(fv.RISK_LABELS["safe"]))


def revised_lines(analyses: DataFrame) -> DataFrame:
    """Revised contract as ordered lines (document_id, clause_pos, line_no, kind, text).

    Title, risk line, original lines, and for high and medium clauses the rewrite.
    """
    kind_text = "array<struct<kind:string,text:string>>"

    def line(kind: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text"))).cast(kind_text)

    def lines(kind: str, text: Column) -> Column:
        # "\r\n", "\r" and "\n" end a line; a final line end adds no empty line
        body = F.regexp_replace(text, r"(?:\r\n|[\r\n])\z", "")
        return F.transform(F.split(body, r"\r\n|[\r\n]"), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))).cast(kind_text)

    choice = final_text(F.col("suggested_rewrite"), F.col("user_override"))
    title = strip(F.concat(F.lit("제"), F.col("clause_index"), F.lit("조 "), F.col("title")))
    risk = F.concat(F.lit("["), risk_label(F.col("risk_level")), F.lit("] "), F.coalesce("explanation", F.lit("")))
    rewritten = F.when(
        R.needs_rewrite(F.col("risk_level")) & F.col("_final.text").isNotNull(),
        F.concat(line("rewrite_label", F.col("_final.label")), lines("rewrite", F.col("_final.text"))),
    ).otherwise(F.array().cast(kind_text))
    everything = F.concat(
        line("title", title),
        line("risk", risk),
        line("original_label", F.lit(fv.ORIGINAL_LABEL)),
        lines("original", F.col("content")),
        rewritten,
        line("blank", F.lit("")),
    )
    return (
        analyses.withColumn("_final", choice)
        .select(*KEYS, F.posexplode(everything).alias("at", "row"))
        .select(*KEYS, (F.col("at") + 1).alias("line_no"), "row.kind", "row.text")
    )


def revised_header(documents: DataFrame, built_at: Column) -> DataFrame:
    """Front lines of the revised contract, one row per line."""
    texts = [
        F.lit(fv.EXPORT_TITLE),
        F.concat(F.lit("원본 파일: "), F.col("filename")),
        F.concat(F.lit("생성일: "), F.date_format(built_at, "yyyy-MM-dd HH:mm")),
        F.concat(
            F.lit("전체 조항 "), F.col("total_clauses"), F.lit("개 / 위험 조항 "), F.col("risky_clauses"), F.lit("개")
        ),
        F.lit(""),
        F.lit(fv.EXPORT_NOTICE),
        F.lit(""),
    ]
    return documents.select("document_id", F.posexplode(F.array(*texts)).alias("line_no", "text"))


def latest_overrides(log: DataFrame, keys: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Last write wins; a blank text removes the override.

    ``log(keys, text, edited_at)``.  A pre-aggregated max, so a clause edited very often is
    reduced before the shuffle.
    """
    keys = keys or KEYS
    order = ["edited_at"] + ([tie] if tie else [])
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, "text")).alias("last"))
    text = blank_to_null(strip(F.col("last.text")))
    stamp = F.date_format("last.edited_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return last.select(
        *keys,
        text.alias("user_override"),
        F.when(text.isNotNull(), stamp).alias("user_override_at"),
    )
