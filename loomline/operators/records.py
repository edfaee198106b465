"""Corpus records: one schema for statutes and judgments, and what builds them from parsed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_else, padded, prefixed, section_suffix, squash, strip_tags, truncate

SCHEMA = "id string, text string, source string, citation string, type string, metadata map<string,string>"
FIELDS = ("id", "text", "source", "citation", "type", "metadata")
#: Sources and the public addresses that their records point to.
US_CODE, JUDGMENTS, ACTS = "us_code", "courtlistener", "uk_legislation"
JUDGMENT_SITE, ACT_SITE = "https://www.courtlistener.com", "https://www.legislation.gov.uk"


def metadata(**cols: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(c.cast("string") for c in cols.values())))


def _with_heading(citation: Column, heading: Column, body: Column) -> Column:
    return F.when(heading != "", F.concat(citation, F.lit(". "), heading, F.lit("\n\n"), body)).otherwise(F.concat(citation, F.lit("\n\n"), body))


def code_sections(rows: DataFrame) -> DataFrame:
    """title, section, heading, body (from XML) -> records. Rows without a body or number are dropped."""
    rows = rows.where((F.col("body") != "") & (F.col("section") != ""))
    cite = F.concat("title", F.lit(" U.S.C. § "), "section")
    return rows.select(
        F.concat(F.lit("usc-"), "title", F.lit("-"), "section").alias("id"), _with_heading(cite, F.col("heading"), F.col("body")).alias("text"),
        F.lit(US_CODE).alias("source"), cite.alias("citation"), F.lit("statute").alias("type"),
        metadata(title=F.col("title"), section=F.col("section"), heading=F.col("heading")).alias("metadata"),
    )


def code_granules(rows: DataFrame) -> DataFrame:
    """granule_id, title, year, heading, body (from HTML) -> records; here the heading's place is kept when it is empty."""
    rows = rows.where(F.col("body") != "").withColumn("section", section_suffix("granule_id"))
    cite = F.concat("title", F.lit(" U.S.C. § "), "section")
    return rows.select(
        F.col("granule_id").alias("id"), F.concat(cite, F.lit(". "), "heading", F.lit("\n\n"), "body").alias("text"), F.lit(US_CODE).alias("source"),
        cite.alias("citation"), F.lit("statute").alias("type"),
        metadata(
            title=F.col("title"), section=F.col("section"), heading=F.col("heading"),
            package_id=F.concat(F.lit("USCODE-"), F.col("year").cast("string"), F.lit("-title"), "title"), year=F.col("year"),
        ).alias("metadata"),
    )


def act_sections(rows: DataFrame) -> DataFrame:
    """act_title, act_type, year, number, section, heading, body -> records."""
    rows = rows.where((F.col("body") != "") & (F.col("section") != ""))
    cite = F.concat("act_title", F.lit(", s."), "section")
    year, number = F.col("year").cast("string"), F.col("number").cast("string")
    return rows.select(
        F.concat(F.lit("uk-"), "act_type", F.lit("-"), year, F.lit("-"), number, F.lit("-s"), "section").alias("id"),
        _with_heading(cite, F.col("heading"), F.col("body")).alias("text"), F.lit(ACTS).alias("source"), cite.alias("citation"), F.lit("statute").alias("type"),
        metadata(
            act_title=F.col("act_title"), act_type=F.col("act_type"), year=year, number=number, section=F.col("section"), heading=F.col("heading"),
            url=F.concat_ws("/", F.lit(ACT_SITE), "act_type", year, number, F.lit("section"), "section"),
        ).alias("metadata"),
    )


def opinion_text(plain: Column, cited: Column, html: Column) -> Column:
    """Plain text; failing that the marked-up text without its tags."""
    return squash(or_else(plain, strip_tags(or_else(cited, html, F.lit("")))))


def first_citation(raw: Column | str, other: Column) -> Column:
    """The first of a JSON list, a JSON string, or a text that is no JSON, as it is; else (null, an empty list, blank) `other`."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    v = F.try_parse_json(raw)
    listed, text = F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    said = F.when(v.isNull(), raw).when(kind.startswith("ARRAY"), listed).when(kind != "VOID", text)
    return or_else(said, other)


def judgments(hits: DataFrame, opinions: DataFrame | None = None, max_chars: int = 8000, max_docs: int | None = None) -> DataFrame:
    """Search hits (raw JSON fields, `position` their order), left-joined with fetched opinions -> records.

    A hit without a body falls back on its snippet; without that it is dropped, and doesn't count for max_docs."""
    first = F.try_element_at("opinions", F.lit(1))
    h = hits.withColumn("opinion_id", first["id"].cast("string")).withColumn("snippet", first["snippet"])
    if opinions is None:
        h = h.withColumns({"body": F.lit(""), "author_str": F.lit(""), "page_count": F.lit(None).cast("string")})
    else:
        o = opinions.select(F.col("id").cast("string").alias("opinion_id"), opinion_text(F.col("plain_text"), F.col("html_with_citations"), F.col("html")).alias("body"), F.coalesce("author_str", F.lit("")).alias("author_str"), F.col("page_count").cast("string").alias("page_count"))
        h = h.join(o, "opinion_id", "left").withColumn("body", F.coalesce("body", F.lit(""))).withColumn("author_str", F.coalesce("author_str", F.lit("")))
    text = or_else("body", squash("snippet"))
    h = h.withColumn("chosen", text).where(F.col("chosen") != "")
    if max_docs is not None:
        h = h.orderBy("position").limit(max_docs)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    case = or_else("caseName", "caseNameFull", F.lit(""))
    head = F.concat(case, F.lit(" ("), none("court_citation_string"), F.lit(", "), none("dateFiled"), F.lit(")"))
    return h.select(
        F.concat(F.lit("cl-op-"), or_else("opinion_id", none("cluster_id"))).alias("id"), F.concat(head, F.lit("\n\n"), truncate("chosen", max_chars)).alias("text"),
        F.lit(JUDGMENTS).alias("source"), first_citation("citation", or_else(case, F.lit("?"))).alias("citation"), F.lit("judgment").alias("type"),
        metadata(
            case_name=case, court=none("court"), court_id=none("court_id"), date_filed=none("dateFiled"), docket_number=none("docketNumber"),
            cluster_id=none("cluster_id"), opinion_id=F.col("opinion_id"), absolute_url=prefixed(JUDGMENT_SITE, "absolute_url"),
            fetched_full_body=F.col("body") != "", author=F.col("author_str"), page_count=F.col("page_count"),
        ).alias("metadata"),
    )


def display_label(meta: Column | str = "metadata") -> Column:
    """A statute's heading, or a judgment's case name."""
    m = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(F.nullif(m["heading"], F.lit("")), m["case_name"], F.lit(""))


def hit_line(score: Column, source: Column, citation: Column, label: Column) -> Column:
    """A retrieved record as a line of fixed places: score, source, citation and label cut to 30 and 55."""
    cut = lambda c, n: F.left(c, F.lit(n))
    return F.concat(F.lit("  "), F.format_number(score, 3), F.lit("  ["), padded(source, 14, left=True), F.lit("]  "), padded(cut(citation, 30), 30), F.lit("  "), cut(label, 55))


def union_all(*corpora: DataFrame) -> DataFrame:
    """End to end, duplicates kept, columns by name."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def source_counts(records: DataFrame) -> DataFrame:
    """Rows of each source, and of all (source null, level 1)."""
    return records.rollup("source").agg(F.count("*").alias("n"), F.grouping("source").cast("int").alias("level"))


def group_counts(records: DataFrame, group: Column | str, order: Column | str) -> DataFrame:
    """Rows a group, with the first place it was seen at."""
    return records.groupBy((F.col(group) if isinstance(group, str) else group).alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def full_bodies(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("metadata")["fetched_full_body"] == "true").alias("n_full"), F.count("*").alias("n"))


def first_of_group(rows: DataFrame, group: list[str], order: list[str | Column], most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
