"""Reconciling citations with references (O-J1..J10).

``citations`` are the rows of ``extract_citations``; ``references`` those of
``primary_references``.  Equal numbers and names meet in one window per document and
value, over citations and references in one table: where both are partitioned by
document already, nothing is exchanged for it.  Only names without an equal one are
joined, on the document and pieces of the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.styles import in_styles, known_styles
from quire.functions.base import strip
from quire.functions.citation_text import expand_citation_numbers, indel_ratio
from quire.ordering import checkpoint

FUZZY_THRESHOLD = 85
# Two strings reach the threshold only if insertions plus deletions stay below this
# share of their joint length (ratios round half to even, so 84.5 is not enough).
_EDIT_SHARE = 0.155

# Texts of the two format issues.
USE_AMPERSAND = 'Should use "&" instead of "and" in parenthetical citation (APA 7 §8.21)'
USE_AND = 'Should use "and" instead of "&" in narrative citation (APA 7 §8.21)'

KEY = ["doc_id", "author", "year"]
CIT = ["doc_id", "idx", "cit_no"]


def citation_system(citations: DataFrame) -> DataFrame:
    """O-J1: ``numeric`` if more citations lack a year than have one, else ``author-date``."""
    numeric = F.count_if(F.col("year").isNull()) > F.count_if(F.col("year").isNotNull())
    return citations.groupBy("doc_id").agg(
        F.when(numeric, "numeric").otherwise("author-date").alias("system")
    )


def _by_document(rows: DataFrame) -> DataFrame:
    """The rows by document, into as many partitions for every table, so that tables meet without a further exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _by_number(citations: DataFrame) -> DataFrame:
    """The citations, each with whether it is matched by number: it has no year and its document is numeric."""
    doc = Window.partitionBy("doc_id")
    bare = F.col("year").isNull()
    numeric = F.count_if(bare).over(doc) > F.count_if(~bare).over(doc)
    rows = _by_document(citations.select(*CIT, "text", F.lower("author").alias("author"), "year"))
    return rows.withColumn("_by_number", bare & numeric)


def _reference_number() -> Column:
    prefix = F.nullif(F.regexp_extract(F.expr(strip("content")), r"^(\d{1,3})[.)]", 1), F.lit(""))
    return F.coalesce(F.col("ref.original_number"), prefix.cast("int"))


def _family() -> Column:
    return F.lower(F.col("ref.authors")[0]["family"])


def _named() -> Column:
    return (F.size("ref.authors") > 0) & F.col("ref.year").isNotNull()


def reference_numbers(references: DataFrame) -> DataFrame:
    """``(doc_id, number, ref_idx)``; of references sharing a number the last one counts."""
    return (
        references.select("doc_id", _reference_number().alias("number"), "ref_idx")
        .filter("number is not null")
        .groupBy("doc_id", "number")
        .agg(F.max("ref_idx").alias("ref_idx"))
    )


# What a row of the table that citations and references meet in is.
_CITED, _LISTED, _SIMILAR = 0, 1, 2


def _meet(rows: DataFrame, references: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Rows of ``_by_number``, one per cited number or name, with the reference each one finds.

    A number finds its last reference, a name its first, or else the one of ``similar``.  Every row has
    one key, a number or a name and year, and both sides and ``similar`` are put into one table, so that
    a window over each key takes the place of a join.
    """
    no_number, no_text, by_number = F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("_by_number")
    dated = ~by_number & (F.col("author") != "") & F.col("year").isNotNull()
    cited = rows.select(
        *CIT,
        "text",
        "_by_number",
        F.lit(_CITED).alias("_kind"),
        F.when(dated, F.col("author")).alias("author"),
        F.when(dated, F.col("year")).alias("year"),
        F.lit(None).cast("int").alias("ref_idx"),
        F.explode_outer(F.when(by_number, expand_citation_numbers("text"))).alias("number"),
    )
    number, family = _reference_number(), _family()
    keys = F.array(
        F.when(number.isNotNull(), F.struct(number.alias("number"), no_text.alias("author"), no_text.alias("year"))),
        F.when(
            _named() & family.isNotNull(),
            F.struct(no_number.alias("number"), family.alias("author"), F.col("ref.year").alias("year")),
        ),
    )
    listed = _by_document(references.select("doc_id", "ref_idx", F.filter(keys, lambda k: k.isNotNull()).alias("keys")))
    listed = listed.select("doc_id", "ref_idx", F.inline("keys"))
    tables = [cited, listed.withColumn("_kind", F.lit(_LISTED))]
    if similar is not None:
        tables.append(_by_document(similar).withColumn("_kind", F.lit(_SIMILAR)))
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    key = Window.partitionBy("doc_id", "number", "author", "year")

    def over(aggregate, kind: int) -> Column:
        return aggregate(F.when(F.col("_kind") == kind, F.col("ref_idx"))).over(key)

    met = both.select(
        *CIT,
        "text",
        "number",
        "author",
        "_by_number",
        "_kind",
        over(F.max, _LISTED).alias("_last"),
        over(F.min, _LISTED).alias("_first"),
        over(F.min, _SIMILAR).alias("_similar"),
    ).filter(F.col("_kind") == _CITED)
    named, last, first, near = F.col("author").isNotNull(), F.col("_last"), F.col("_first"), F.col("_similar")
    return met.select(
        *CIT,
        "text",
        "number",
        F.when(F.col("number").isNotNull(), last).when(named, F.coalesce(first, near)).alias("ref_idx"),
        F.when(F.col("number").isNotNull() & last.isNotNull(), "number")
        .when(named & first.isNotNull(), "exact")
        .when(named & near.isNotNull(), "fuzzy")
        .alias("method"),
    )


def match_numeric(citations: DataFrame, references: DataFrame) -> DataFrame:
    """O-J2: one row per cited number; ``ref_idx`` is null where no reference has it."""
    return _meet(_by_number(citations).filter("_by_number"), references)


def reference_names(references: DataFrame) -> DataFrame:
    """``(doc_id, author, year, ref_idx)``: lower-cased first family name, first reference by order."""
    return (
        references.filter(_named())
        .select("doc_id", _family().alias("author"), F.col("ref.year").alias("year"), "ref_idx")
        .groupBy(*KEY)
        .agg(F.min("ref_idx").alias("ref_idx"))
    )


def _cited_names(citations: DataFrame) -> DataFrame:
    return citations.select("doc_id", F.lower("author").alias("author"), "year").filter(
        "author <> '' and year is not null"
    ).distinct()


def match_author_date_exact(citations: DataFrame, references: DataFrame) -> DataFrame:
    """O-J3: cited names whose family name and year a reference has."""
    return _cited_names(citations).join(reference_names(references), KEY).select(*KEY, "ref_idx")


def _tau(la: Column, lb: Column) -> Column:
    return F.floor(F.lit(_EDIT_SHARE) * (la + lb)).cast("int")


def _longest(n: Column) -> Column:
    return F.floor(n * ((1 + _EDIT_SHARE) / (1 - _EDIT_SHARE))).cast("int")


def _edits(lb: Column) -> Column:
    return _tau(_longest(lb), lb)


def _piece(lb: Column, j: Column, k: Column) -> tuple[Column, Column]:
    at = F.floor(j * lb / k).cast("int")
    return at, (F.floor((j + 1) * lb / k) - at).cast("int")


def _ratio_candidates(cited: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of the same document and year that can reach the threshold.

    A family name is cut into one piece more than the edits allowed; one piece must then
    survive unchanged in the cited name, shifted by at most that many places.  Joining on
    the pieces finds every such pair without comparing all names of a year.
    """
    size, n, j = F.length("author"), F.col("n"), F.col("j")
    k = _edits(n) + 1
    at, width = _piece(n, j, k)
    pieces = (
        names.withColumn("n", size)
        .withColumn("j", F.explode(F.sequence(F.lit(0), _edits(F.col("n")))))
        .select(
            "doc_id",
            "year",
            F.col("author").alias("family"),
            "ref_idx",
            "n",
            "j",
            F.substring("author", at + 1, width).alias("piece"),
        )
    )
    shift = F.col("shift")
    shortest = F.ceil(size * ((1 - _EDIT_SHARE) / (1 + _EDIT_SHARE))).cast("int")
    lengths = names.select("doc_id", "year", size.alias("n")).distinct()
    probes = (
        cited.withColumn("n", F.explode(F.sequence(shortest, _longest(size))))
        # Only lengths that a name of this document and year has are worth probing.
        .join(lengths, ["doc_id", "year", "n"], "left_semi")
        .withColumn("j", F.explode(F.sequence(F.lit(0), _edits(F.col("n")))))
        .withColumn("shift", F.explode(F.sequence(-_edits(F.col("n")), _edits(F.col("n")))))
        .filter((at + shift >= 0) & (at + shift + width <= size))
        .select(*KEY, "n", "j", F.substring("author", at + shift + 1, width).alias("piece"))
    )
    pairs = probes.join(pieces, ["doc_id", "year", "n", "j", "piece"])
    return pairs.select(*KEY, "family", "ref_idx").distinct()


def _contained(inner: DataFrame, outer: DataFrame, keys: list[str], short: str, long: str, q: int = 3) -> DataFrame:
    """Pairs in which the name ``short`` is part of the name ``long``, of equal ``keys``.

    A name that contains another holds each of its pieces of ``q`` characters, so the pair meets at
    the one piece of the shorter name that is rarest among the longer ones; names under ``q``
    characters are one piece, of their own length.
    """
    def pieces(name: Column, width: Column) -> Column:
        ends = F.length(name) - width + 1
        return F.array_distinct(F.transform(F.sequence(F.lit(1), ends), lambda i: F.substring(name, i, width)))

    widths = F.array(*[F.lit(w) for w in range(1, q + 1)])
    held = outer.withColumn("_w", F.explode(F.filter(widths, lambda w: w <= F.length(long))))
    held = held.withColumn("_piece", F.explode(pieces(F.col(long), F.col("_w")))).drop("_w")
    rare = held.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    asked = inner.filter(F.length(short) > 0).withColumn("_piece", F.explode(pieces(F.col(short), F.least(F.length(short), F.lit(q)))))
    own = inner.columns
    anchors = asked.join(rare, [*keys, "_piece"], "left").groupBy(*own).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("_a")
    )
    anchors = anchors.filter("_a.n > 0").select(*own, F.col("_a._piece").alias("_piece"))
    return anchors.join(held, [*keys, "_piece"]).filter(F.col(long).contains(F.col(short))).drop("_piece")


def match_author_date_fuzzy(cited: DataFrame, names: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """O-J4: for cited names, the first reference of the same year with a similar family name.

    ``ratio``: similarity of at least 85; ``substring``: either name contains the other.
    """
    if fuzzy == "ratio":
        pairs = _ratio_candidates(cited, names).filter(
            indel_ratio("author", "family") >= FUZZY_THRESHOLD
        )
    elif fuzzy == "substring":
        families = names.select("doc_id", "year", F.col("author").alias("family"), "ref_idx")
        keys = ["doc_id", "year"]
        inside = _contained(families, cited, keys, "family", "author")
        around = _contained(cited, families, keys, "author", "family")
        pairs = inside.select(*KEY, "ref_idx").unionByName(around.select(*KEY, "ref_idx"))
    else:
        raise ValueError(f"unknown fuzzy mode {fuzzy!r}")
    return pairs.groupBy(*KEY).agg(F.min("ref_idx").alias("ref_idx"))


def _similar(rows: DataFrame, references: DataFrame, fuzzy: str) -> DataFrame:
    """The similar reference of each cited name that no reference has: ``(doc_id, author, year, ref_idx)``.

    Names are joined only in documents and years that have both such a name and a reference.  These few
    rows are written once, as several steps read them.
    """
    cited = rows.filter(~F.col("_by_number") & (F.col("author") != "") & F.col("year").isNotNull())
    names = references.filter(_named()).select("doc_id", _family().alias("author"), F.col("ref.year").alias("year"), "ref_idx")
    keys = cited.select(*KEY, F.lit(None).cast("int").alias("ref_idx")).unionByName(_by_document(names))
    keys = keys.groupBy(*KEY).agg(F.min("ref_idx").alias("ref_idx"))
    year = Window.partitionBy("doc_id", "year")
    known, open_ = F.col("ref_idx").isNotNull(), F.col("ref_idx").isNull()
    keys = keys.select(*KEY, "ref_idx", F.bool_or(known).over(year).alias("_known"), F.bool_or(open_).over(year).alias("_open"))
    few = checkpoint(keys.filter("_known and _open").select(*KEY, "ref_idx"))
    return match_author_date_fuzzy(few.filter(open_).select(*KEY), few.filter(known), fuzzy)


def _match(citations: DataFrame, references: DataFrame, fuzzy: str, named_only: bool) -> DataFrame:
    rows = _by_number(citations)
    similar = _similar(rows, references, fuzzy)
    return _meet(rows.filter("not _by_number") if named_only else rows, references, similar)


def match_author_date(citations: DataFrame, references: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """O-J3 then O-J4 for every citation matched by author and year."""
    return _match(citations, references, fuzzy, named_only=True)


def match_citations(citations: DataFrame, references: DataFrame, fuzzy: str = "ratio") -> DataFrame:
    """All citations, each with its reference or none: number matches and name matches."""
    return _match(citations, references, fuzzy, named_only=False)


def orphan_citations(matches: DataFrame) -> DataFrame:
    """O-J6: citations, or cited numbers, without a reference."""
    return matches.filter("ref_idx is null").select(*CIT, "text", "number")


def _with_use(references: DataFrame, matches: DataFrame) -> DataFrame:
    """The references, each with whether it is matched at least once, by a window instead of a join."""
    used = matches.filter("ref_idx is not null").select("doc_id", "ref_idx", F.lit(True).alias("_hit"))
    both = references.withColumn("_hit", F.lit(False)).unionByName(used, allowMissingColumns=True)
    hit = F.bool_or("_hit").over(Window.partitionBy("doc_id", "ref_idx"))
    return both.withColumn("_used", hit).filter("not _hit").drop("_hit")


def uncited_references(references: DataFrame, matches: DataFrame, chars: int | None = None) -> DataFrame:
    """O-J7: references never matched, with the first ``chars`` characters of their text; None: all."""
    text = F.col("content") if chars is None else F.substring("content", 1, chars)
    rows = references.select("doc_id", "ref_idx", text.alias("reference_text"))
    return _with_use(rows, matches).filter("not _used").select("doc_id", "ref_idx", "reference_text")


def cited_references(references: DataFrame, matches: DataFrame) -> DataFrame:
    """O-J8: references matched at least once."""
    return _with_use(references, matches).filter("_used").drop("_used")


def format_issues(citations: DataFrame, style_specs: DataFrame, doc_styles: DataFrame) -> DataFrame:
    """O-J9: ``and`` in brackets, or ``&`` in running text, against the document's style."""
    rules = style_specs.select(
        "style_id",
        F.col("in_text_citations.ampersand_in_parenthetical").alias("amp"),
        F.col("in_text_citations.and_in_narrative").alias("word"),
    )
    text, kind = F.col("text"), F.col("citation_type")
    odd = citations.filter(text.contains(" and ") | text.contains(" & "))
    wants_amp = (
        F.col("amp") & (kind == "parenthetical") & text.contains(" and ") & ~text.contains(" & ")
    )
    wants_word = (
        F.col("word") & (kind == "narrative") & text.contains(" & ") & ~F.lower(text).contains(" and ")
    )
    issue = F.when(wants_amp, USE_AMPERSAND).when(wants_word, USE_AND)
    joined = in_styles(odd, doc_styles, rules).filter(wants_amp | wants_word)
    return joined.select("style_id", *CIT, "text", issue.alias("issue"))


def citation_report(
    documents: DataFrame,
    citations: DataFrame,
    references: DataFrame,
    style_specs: DataFrame,
    doc_styles: DataFrame,
    fuzzy: str = "ratio",
    matches: DataFrame | None = None,
) -> DataFrame:
    """O-J10: counts and a 0-100 consistency score of each document in its style.

    ``documents`` has one row per ``doc_id``; ``doc_styles`` says which style each is set in.
    ``matches`` are the matched citations, where they are at hand already.
    """
    matches = match_citations(citations, references, fuzzy) if matches is None else matches
    doc_styles = known_styles(doc_styles, style_specs)
    cits = citations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_citations"))
    refs = references.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_references"))
    found = matches.groupBy("doc_id").agg(
        F.count_if(F.col("ref_idx").isNotNull()).alias("matched"),
        F.count_if(F.col("ref_idx").isNull()).alias("orphans"),
        F.count_distinct(F.col("ref_idx")).alias("cited"),
    )
    issues = format_issues(citations, style_specs, doc_styles).groupBy("doc_id", "style_id").agg(
        F.count(F.lit(1)).alias("format_issues")
    )
    df = documents.select("doc_id").join(cits, "doc_id", "left").join(refs, "doc_id", "left")
    df = in_styles(df.join(found, "doc_id", "left"), doc_styles, style_specs.select("style_id"))
    df = df.join(issues, ["doc_id", "style_id"], "left").fillna(0)
    bad = F.col("orphans") + (F.col("total_references") - F.col("cited")) + F.col("format_issues")
    items = F.col("total_citations") + F.col("total_references")
    score = F.when(items == 0, 100.0).otherwise(
        F.greatest(F.lit(0.0), F.bround((1 - bad / items) * 100, 1))
    )
    return df.select(
        "doc_id",
        "style_id",
        "total_citations",
        "total_references",
        "matched",
        F.col("orphans").alias("orphan_citations"),
        (F.col("total_references") - F.col("cited")).alias("uncited_references"),
        "format_issues",
        score.alias("consistency_score"),
    )
