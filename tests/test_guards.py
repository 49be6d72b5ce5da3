"""The cheap guards before patterns leave out nothing that the patterns take."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions.base import matches

OPENINGS = [
    "123 | PNAS doi", "www.pnas.org/cgi/doi", "١٢٣ Smith et al.", "Downloaded from x", "DOWNLOADED by y", "This article is open access",
    "Freely available open access", "2004/pnas.12", "Smith and Jones et al. PNAS", "smith ET  AL Nature", "ABSTRACT", "Abstract", "ABCD",
    "Author contributions: a", "The authors declare no conflict", "The authors declare no interest", "To whom correspondence should",
    "1 To whom correspondence should", "Data deposition", "data availability", "Publiſhed online", "Received for publication",
    "ſupporting Information x", "Supplementary Material x", "See Commentary x", "Copyright 2004", "© 2004", "(c) 2004", "Corresponding author",
    "Conflict of interest statement", "Funding: x", "AcKnowledgments: grant", "12", "A.B. performed research", "K.B. wrote the paper",
    "Keywords: a", "Keywords - a", "keyword – a", "1. A", "١) B", "(1) A", "Figure 1", "fig. ٢", "TABLE 3", "Tab. 4", "", "x", "\U0001d7d9. A",
]


def test_guards_change_nothing(spark):
    rows = [(p + o,) for o in OPENINGS for p in ("", " ", "x ")]
    df = spark.createDataFrame(rows, "s string")
    artifact = (P.PAGE_ARTIFACT, P.ALL_CAPS_ARTIFACT, P.FOOTNOTE_ARTIFACT, P.FOOTNOTE_MARKER, P.CONTRIBUTION)
    plain = {
        P.is_page_artifact: artifact,
        P.is_contribution_line: (P.CONTRIBUTION,),
        P.is_keyword_line: (P.KEYWORD_LINE,),
        P.is_numbered_reference: (P.NUMBERED_REFERENCE,),
        P.is_figure_caption: (P.FIGURE_CAPTION,),
        P.is_table_caption: (P.TABLE_CAPTION,),
    }
    for guarded, patterns in plain.items():
        bare = F.expr(" or ".join(matches("s", p) for p in patterns))
        assert df.filter(bare).count() > 0
        assert df.filter(~guarded("s").eqNullSafe(bare)).collect() == [], guarded.name
