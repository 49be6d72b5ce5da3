"""Inputs shared by the queries: element tables derived from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.styles import resolve_style
from quire.operators.structure import SECTION_KEYWORDS, detect_structure
from quire.ordering import reindex
from quire.plans.manuscripts import CTES, manuscript_elements, manuscript_lines
from quire.sources.styles import builtin_style_specs
from quire.sources.text import from_lines, read_text_manuscripts


DOC_LINES = (
    "lines as (select doc_id, cast(i - 1 as int) as idx, c as content from (select doc_id, "
    "unnest(string_split(text, chr(10))) as c, generate_subscripts(string_split(text, chr(10)), 1) as i "
    "from documents))"
)
MANUSCRIPT_LINES = CTES

# Lines with page artifacts planted by position.
_NOISE = """case when idx % 11 = 5 then 'Downloaded from a site' when idx % 13 = 6 then 'MICROBIOLOGY'
 when idx % 17 = 3 then '12' when idx % 19 = 8 then 'A.B. and C.D. performed research'
 when idx % 23 = 9 then 'Funding: none' when idx % 29 = 4 then '' else content end"""
NOISY_LINES = DOC_LINES.replace("lines as (", "plain as (", 1) + (
    f", lines as (select doc_id, idx, {_NOISE} as content from plain)"
)
# Manuscripts without the label line of their reference list.
UNLABELLED_LINES = MANUSCRIPT_LINES.replace("lines as (", "labelled_lines as (", 1) + (
    ", lines as (select doc_id, cast(row_number() over (partition by doc_id order by idx) - 1 as int) as idx, "
    "content from labelled_lines where content <> 'References')"
)

SECTION_NAMES = "kw as (select * from (values " + ", ".join(
    f"('{k}', '{r}')" for r, ks in SECTION_KEYWORDS.items() for k in ks
) + ") as t(keyword, krole))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_elements(spark, sf_dir).select("doc_id", "idx", "content")


def doc_elements(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    return read_text_manuscripts(table(spark, sf_dir, "documents"), by_document=by_document)


def noisy_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_elements(spark, sf_dir, by_document=True).withColumn("content", F.expr(_NOISE))


def unlabelled_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = manuscript_lines(spark, sf_dir).filter("content <> 'References'")
    return from_lines(reindex(lines))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_structure(doc_elements(spark, sf_dir, by_document=True))


def labelled_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_structure(manuscript_elements(spark, sf_dir))


# The style each manuscript asks for; one id is unknown and falls back to apa7.
_ASKED = "element_at(array('apa7', 'mla', 'ieee', 'vancouver', 'chicago', 'nature'), cast(doc_id % 6 as int) + 1)"
ASSIGNED = (
    "case doc_id % 6 when 1 then 'mla' when 2 then 'ieee' when 3 then 'vancouver' when 4 then 'chicago' else 'apa7' end"
)


def document_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style every manuscript is set in, as its request resolves."""
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    null = F.lit(None).cast("string")
    requests = docs.select(
        F.col("doc_id").alias("request_id"), F.expr(_ASKED).alias("style_id"), null.alias("guidelines_text"), null.alias("url_text")
    )
    interpreted = requests.filter("false").select("request_id", F.col("style_id").alias("spec_id"))
    resolved = resolve_style(requests, interpreted, builtin_style_specs(spark))
    return resolved.select(F.col("request_id").alias("doc_id"), F.col("spec_id").alias("style_id"))


def assigned(sql: str) -> str:
    """Of a result for all styles, each document's rows in its own style."""
    return f"select * from ({sql}) as every_style where style_id = {ASSIGNED}"


__all__ = [
    "ASSIGNED",
    "assigned",
    "document_styles",
    "DOC_LINES",
    "MANUSCRIPT_LINES",
    "NOISY_LINES",
    "SECTION_NAMES",
    "UNLABELLED_LINES",
    "builtin_style_specs",
    "doc_elements",
    "doc_lines",
    "labelled_documents",
    "labelled_manuscripts",
    "manuscript_elements",
    "manuscript_lines",
    "noisy_elements",
    "table",
    "unlabelled_elements",
]
