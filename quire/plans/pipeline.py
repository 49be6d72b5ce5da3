"""The full analysis as one composition: elements in, result tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.operators.citations import extract_citations, primary_references, references_of
from quire.operators.formatting import format_changes, target_format
from quire.operators.matching import citation_report, match_citations
from quire.operators.merge import merge
from quire.operators.structure import detect_structure, structure_summary_map
from quire.ordering import Limit, long_documents


@dataclass(frozen=True)
class Analysis:
    """Result tables of one run."""

    elements: DataFrame
    merged: DataFrame
    summary: DataFrame
    citations: DataFrame
    references: DataFrame
    matches: DataFrame | None
    report: DataFrame | None
    plan: DataFrame | None
    changes: DataFrame | None


def analyse(
    elements: DataFrame,
    specs: DataFrame,
    doc_styles: DataFrame,
    fuzzy: str = "ratio",
    max_rows: Limit = None,
    tables: tuple[str, ...] | None = None,
) -> Analysis:
    """Label, extract, reconcile and plan every document in the style ``doc_styles`` gives it.

    Tables that several results read - labelled elements, citations, references - are
    computed once and persisted.  With ``tables`` only these and the three are planned; others are None.
    """
    limit = long_documents(elements, max_rows)
    labelled = detect_structure(elements, limit).persist()
    citations = extract_citations(labelled).persist()
    references = primary_references(references_of(labelled, limit)).persist()
    documents = labelled.select("doc_id").distinct()
    merged = merge(labelled, max_rows=limit)

    def planned(name: str, build) -> DataFrame | None:
        return build() if tables is None or name in tables else None

    return Analysis(
        elements=labelled,
        merged=merged,
        summary=structure_summary_map(labelled),
        citations=citations,
        references=references,
        matches=planned("matches", lambda: match_citations(citations, references, fuzzy)),
        report=planned("report", lambda: citation_report(documents, citations, references, specs, doc_styles, fuzzy)),
        plan=planned("plan", lambda: target_format(merged, specs, doc_styles)),
        changes=planned("changes", lambda: format_changes(merged, specs, doc_styles, limit)),
    )
