"""Knowledge-base sources.

Every reader returns the same KB columns, so the sources can be united by name.  Files
are read in parallel by Spark; parsing is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import markdown as M
from clausewise.functions import text as X
from clausewise.functions.responses import nested_lists, string_list
from clausewise.functions.udfs import nfc
from clausewise.operators import keywords as K
from clausewise.operators.skew import top_n

KB_COLUMNS = {
    "id": "string", "text": "string", "source": "string", "contract_type": "string",
    "law_name": "string", "law_kind": "string", "article": "string", "article_no": "int",
    "sub_no": "int", "article_title": "string", "siheng_date": "string", "case_no": "string",
    "court": "string", "case_name": "string", "date": "string", "section": "string",
    "chunk_idx": "int", "filename": "string", "topic": "string", "advantage": "string",
    "article_idx": "int",
    # arrival order inside a source: path, then position inside the file
    "src_path": "string", "src_pos": "int",
}


def kb_rows(df: DataFrame) -> DataFrame:
    """Project to the KB columns; absent ones are null."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in KB_COLUMNS.items()
        ]
    )


def _path() -> Column:
    """File path with percent escapes undone, in NFC form."""
    raw = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    return nfc(F.url_decode(raw))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; malformed files are skipped."""
    reader = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
    )
    return reader.json(path).select("*", _path().alias("src_path"))


def _markdown(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    return reader.text(path, wholetext=True).select(F.col("value").alias("md"), _path().alias("src_path"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def seed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Built-in KB rows from JSON lines (id, text, contract_type, source, article, topic[, src_pos]).

    ``src_pos`` is a row's declared place; without it rows of a file go by id.
    """
    schema = "id string, text string, contract_type string, source string, article string, topic string, src_pos int"
    rows = spark.read.schema(schema).json(path)
    return kb_rows(rows.withColumn("src_path", _path()))


def _cut(col: Column, size: int | None) -> Column:
    return col if size is None else X.head(col, size)


def clause_rows(
    articles: DataFrame, size: int | None = None, basis_size: int | None = None, laws_size: int | None = None, min_chars: int = 10
) -> DataFrame:
    """KB rows of standard-clause files.

    Texts are kept whole unless a size is given; articles shorter than ``min_chars`` are left out
    (``short_articles`` lists them).

    ``articles(filename, src_path, clauseArticle, illdcssBasiss, relateLaword,
    dvAntageous)``: the four fields are lists or scalars as JSON text.  One row per article,
    with the shared grounds and laws as a short tail.
    """
    typed = articles.withColumn("_topic", K.file_topic(F.col("filename"))).filter(F.col("_topic").isNotNull())
    basis = F.array_join(string_list(F.col("illdcssBasiss")), "\n")
    laws = F.array_join(string_list(F.col("relateLaword")), "\n")
    listed = X.non_blank_parts(string_list(F.col("clauseArticle")))
    rows = typed.select(
        "filename", "src_path", "_topic",
        F.when(F.col("dvAntageous") == "2", "불리").otherwise("유리").alias("advantage"),
        basis.alias("_basis"), laws.alias("_laws"),
        F.posexplode(listed).alias("article_idx", "_article"),
    ).filter(F.length("_article") >= min_chars)
    text = _cut(
        F.concat(
            F.lit("[약관-"), F.col("advantage"), F.lit("] "), F.col("_article"),
            F.when(~X.is_blank(F.col("_basis")), F.concat(F.lit("\n판단근거: "), _cut(F.col("_basis"), basis_size))).otherwise(""),
            F.when(~X.is_blank(F.col("_laws")), F.concat(F.lit("\n관련법령: "), _cut(F.col("_laws"), laws_size))).otherwise(""),
        ),
        size,
    )
    return kb_rows(
        rows.withColumn("text", text)
        .withColumn("id", X.content_id(F.lit("clause"), F.col("text")))
        .withColumn("source", F.lit("aihub_약관"))
        .withColumn("topic", F.col("_topic.topic"))
        .withColumn("contract_type", F.col("_topic.contract_type"))
        .withColumn("src_pos", F.col("article_idx"))
    )


def short_articles(articles: DataFrame, min_chars: int = 10) -> DataFrame:
    """What ``clause_rows`` leaves out for its length: (filename, src_path, article_idx, article)."""
    listed = X.non_blank_parts(string_list(F.col("clauseArticle")))
    typed = articles.filter(K.file_topic(F.col("filename")).isNotNull())
    return typed.select("filename", "src_path", F.posexplode(listed).alias("article_idx", "article")).filter(
        F.length("article") < min_chars
    )


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    schema = "clauseArticle string, illdcssBasiss string, relateLaword string, dvAntageous string"
    return clause_rows(_json(spark, path, schema).withColumn("filename", file_name(F.col("src_path"))))


def judgment_rows(cases: DataFrame, size: int = 1500, overlap: int = 150, laws_size: int | None = None) -> DataFrame:
    """KB rows of judgments: reasoning and facts in overlapping chunks.

    ``cases(src_path, info struct, facts, dcss)``, the last two as JSON text.
    """
    info = F.col("info")
    base = cases.select(
        "src_path",
        X.computed(
            case_name=F.coalesce(info["caseNm"], F.lit("")),
            case_no=F.coalesce(info["caseNo"], F.lit("")),
            court=F.coalesce(info["courtNm"], F.lit("")),
            _laws=F.array_join(string_list(info["relateLaword"]), " "),
            _facts=F.array_join(nested_lists(F.col("facts")), "\n"),
            _dcss=F.array_join(nested_lists(F.col("dcss")), "\n"),
        ),
    )
    everything = base.withColumn("_all", F.concat_ws(" ", "case_name", "_laws", "_facts", "_dcss"))
    routed = everything.select("*", X.computed(contract_type=K.judgment_type(F.col("_all")))).filter(
        F.col("contract_type").isNotNull()
    )
    header = F.concat(
        F.lit("[판결문] "), F.col("court"), F.lit(" "), F.col("case_no"), F.lit(" - "), F.col("case_name")
    )
    tail = F.when(~X.is_blank(F.col("_laws")), F.concat(F.lit("\n관련법령: "), _cut(F.col("_laws"), laws_size))).otherwise("")
    part = "array<struct<section:string,chunk_idx:int,label:string,body:string>>"
    reasoning = F.transform(
        X.chunk(F.col("_dcss"), size, overlap),
        lambda c, i: F.struct(F.lit("판단"), i, F.lit("judgment-dcss"), c),
    ).cast(part)
    facts = F.when(
        ~X.is_blank(F.col("_facts")),
        F.transform(
            X.chunk(X.strip(F.col("_facts")), size, overlap),
            lambda c, i: F.struct(F.lit("기초사실"), i, F.lit("judgment-facts"), c),
        ),
    ).otherwise(F.array()).cast(part)
    rows = routed.select("*", F.posexplode(F.concat(reasoning, facts)).alias("src_pos", "_part")).select("*", "_part.*")
    text = F.concat(header, F.lit("\n"), F.col("section"), F.lit(": "), F.col("body"), tail)
    return kb_rows(
        rows.withColumn("text", text)
        .withColumn("id", X.content_id(F.col("label"), F.col("text")))
        .withColumn("source", F.lit("aihub_판결문"))
        .withColumn("topic", X.lookup(F.col("contract_type"), fv.JUDGMENT_TOPICS))
    )


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "info struct<caseNm:string,caseNo:string,courtNm:string,relateLaword:string>, facts string, dcss string"
    )
    cases = _json(spark, path, schema)
    return judgment_rows(cases.filter(F.contains("src_path", F.lit(fv.CIVIL_DIR))))


def route_articles(
    articles: DataFrame, law_map: dict[str, list[str]] | None = None, ranges: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Fan each article out to the contract types of its law.

    The civil code itself is routed by article number; its decree and all other laws go to
    every mapped type.  Mapping and ranges are small constants, so this is a projection and
    one explode rather than a join.
    """
    law_map = law_map or fv.LAW_CONTRACT_TYPES
    ranges = ranges or fv.CIVIL_CODE_RANGES
    types = F.create_map(
        *[x for law, ts in law_map.items() for x in (F.lit(law), F.array(*[F.lit(t) for t in ts]))]
    )
    fanned = articles.withColumn("contract_type", F.explode(F.try_element_at(types, F.col("law_name"))))
    inside = F.lit(False)
    for ct, (lo, hi) in ranges.items():
        inside = inside | ((F.col("contract_type") == ct) & F.col("article_no").between(lo, hi))
    ranged = (F.col("law_name") == fv.CIVIL_CODE) & (F.col("law_kind") == fv.ACT_KIND)
    return fanned.filter(~ranged | inside)


def law_rows(files: DataFrame, size: int | None = None, min_chars: int = 20) -> DataFrame:
    """KB rows of statute files.  ``files(md, law_name, law_kind, src_path)``.

    Articles are kept whole unless ``size`` is given; bodies shorter than ``min_chars`` (deleted articles) are left out.
    """
    block = F.col("_fm")
    parsed = files.select("*", X.computed(_fm=M.front_matter(F.col("md")))).filter(
        block.isNotNull() & M.is_in_force(block)
    )
    articles = parsed.select(
        "law_name", "law_kind", "src_path",
        F.coalesce(M.value(block, "시행일자"), F.lit("")).alias("siheng_date"),
        F.posexplode(M.law_articles(M.after_front_matter(F.col("md")))).alias("src_pos", "_a"),
    ).select("*", F.col("_a.article_no").alias("article_no"), F.col("_a.sub_no").alias("sub_no"),
             F.col("_a.title").alias("article_title"), F.col("_a.body").alias("_body"))
    routed = route_articles(articles.filter(F.length("_body") >= min_chars))
    kind = F.col("law_kind")
    name = F.when(kind != fv.ACT_KIND, F.concat_ws(" ", "law_name", "law_kind")).otherwise(F.col("law_name"))
    text = _cut(
        F.concat(
            F.lit("["), kind, F.lit("] "), name, F.lit(" "),
            X.article_label(F.col("article_no"), F.col("sub_no")),
            F.lit(" ("), F.col("article_title"), F.lit(")\n"),
            F.regexp_replace("_body", r"\n{3,}", "\n\n"),
        ),
        size,
    )
    return kb_rows(
        routed.withColumn("text", text)
        .withColumn("id", X.content_id(F.concat_ws("-", F.lit("law"), "contract_type", "law_kind"), F.col("text")))
        .withColumn("source", F.lit("law"))
    )


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """Statutes laid out as ``{law}/{act, decree, rule}.md``."""
    kinds = dict(fv.LAW_FILES)
    files = (
        _markdown(spark, path)
        .withColumn("law_name", parent_dir(F.col("src_path")))
        .withColumn("law_kind", X.lookup(file_name(F.col("src_path")), kinds))
        .filter(F.col("law_kind").isNotNull() & F.col("law_name").isin(list(fv.LAW_CONTRACT_TYPES)))
    )
    return law_rows(files)


def precedent_rows(
    files: DataFrame, per_type_cap: int = 0, size: int | None = None, reference_size: int | None = None, min_chars: int = 50
) -> DataFrame:
    """KB rows of precedents; with a ``per_type_cap``, so many per type in path order.

    Texts are kept whole unless a size is given; precedents with less than ``min_chars`` of holding, gist and
    references are left out.
    """
    # each step is computed once; plain columns would be evaluated again by every filter
    parsed = files.select(
        "src_path",
        X.computed(_fm=M.front_matter(F.col("md")), _s=M.named_sections(M.after_front_matter(F.col("md")))),
    ).filter(F.col("_fm").isNotNull())
    fields = (("사건명", "case_name"), ("사건번호", "case_no"), ("법원명", "court"), ("선고일자", "date"))
    named = parsed.select(
        "src_path",
        X.computed(
            **{name: F.coalesce(M.value(F.col("_fm"), key), F.lit("")) for key, name in fields},
            _head=M.section(F.col("_s"), "판시사항"),
            _gist=M.section(F.col("_s"), "판결요지"),
            _ref=M.section(F.col("_s"), "참조조문"),
        ),
    )
    composite = named.withColumn("_all", F.concat_ws("\n", "_head", "_gist", "_ref"))
    long_enough = composite.filter(F.length(X.strip(F.col("_all"))) >= min_chars)
    typed = long_enough.select("*", X.computed(contract_type=K.precedent_type(F.col("_all")))).filter(
        F.col("contract_type").isNotNull()
    )
    if per_type_cap > 0:
        typed = top_n(typed, ["contract_type"], [F.asc("src_path")], per_type_cap, spread_by=["src_path"]).drop("pos")

    def part(label: str, name: str, size: int | None = None) -> Column:
        body = F.col(name) if size is None else X.head(F.col(name), size)
        return F.when(F.col(name) != "", F.concat(F.lit(label + ": "), body))

    text = _cut(
        F.concat(
            F.lit("[판례] "), F.col("court"), F.lit(" "), F.col("case_no"), F.lit(" ("), F.col("date"), F.lit(") - "),
            F.col("case_name"), F.lit("\n"),
            F.concat_ws("\n", part("판시사항", "_head"), part("판결요지", "_gist"), part("참조조문", "_ref", reference_size)),
        ),
        size,
    )
    return kb_rows(
        typed.withColumn("text", text)
        .withColumn("id", X.content_id(F.concat_ws("-", F.lit("prec"), "contract_type"), F.col("text")))
        .withColumn("source", F.lit("precedent_kr"))
        .withColumn("src_pos", F.lit(0))
    )


def read_precedents(spark: SparkSession, path: str, per_type_cap: int = 0) -> DataFrame:
    """Precedents below the civil and administrative folders of ``path``."""
    inside = F.lit(False)
    root = path.rstrip("/").split(":", 1)[-1]
    for folder in fv.PRECEDENT_DIRS:
        inside = inside | F.contains("src_path", F.lit(f"{root}/{folder}/"))
    return precedent_rows(_markdown(spark, path).filter(inside), per_type_cap)


def read_validation(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Labelled lease clauses below ``path``: text, ground truth, grounds."""
    schema = "clauseArticle string, illdcssBasiss string, dvAntageous string"
    files = _json(spark, path, schema).withColumn("filename", file_name(F.col("src_path")))
    folder = F.substring(F.col("src_path"), F.lit(1), F.length("src_path") - F.length("filename"))
    wanted = files.filter(
        F.contains(folder, F.lit(fv.STANDARD_TERMS_DIR)) & F.contains("filename", F.lit("임대차"))
    )
    return label_truth(
        wanted.select(
            F.array_join(string_list(F.col("clauseArticle")), "\n").alias("clause_text"),
            F.coalesce("dvAntageous", F.lit("")).alias("dv"),
            "filename",
            F.lit(split).alias("split"),
            string_list(F.col("illdcssBasiss")).alias("basis"),
        )
    )


def label_truth(rows: DataFrame) -> DataFrame:
    """Blank texts dropped; '2' (unfavourable) is risky, everything else safe."""
    return rows.filter(~X.is_blank(F.col("clause_text"))).withColumn(
        "ground_truth", F.when(F.col("dv") == "2", "risky").otherwise("safe")
    )
