"""Citations and references inside a text value (O-C1..C5, C7..C9, J5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.base import SPACE_RUN, SPACES, raw, sql_function
from quire.schemas import AUTHOR

# Citation and reference patterns.
NAMES = r"[A-Z][a-zà-ÿ]+(?:\s(?:&|and)\s[A-Z][a-zà-ÿ]+)*(?:\set\sal\.)?"
NUMERIC = r"\((\d{1,3}(?:\s*[,;–\-]\s*\d{1,3})*)\)"
PARENTHETICAL = rf"\(({NAMES},\s*\d{{4}}[a-z]?(?:;\s*{NAMES},\s*\d{{4}}[a-z]?)*)\)"
PART = rf"^({NAMES}),\s*(\d{{4}}[a-z]?)"
NARRATIVE = r"([A-Z][a-zà-ÿ]+(?:\s(?:and|&)\s[A-Z][a-zà-ÿ]+)?(?:\set\sal\.)?)\s*\((\d{4}[a-z]?)\)"
CROSS_REFERENCE = r"(?i)(?:Fig\.?|Figure|Table|Tab\.?|Eq\.?)\s*$"
APA_JOURNAL = (
    r"^(.+?)\s*\((\d{4})\)\.\s*(.+?)\.\s*(.+?),\s*(\d+)(?:\((\d+)\))?,\s*(.+?)\."
    r"(?:\s*(?:https?://)?doi\.org/(.+))?$"
)
NUMBERED_JOURNAL = (
    r"^(\d{1,3})[.)]\s*(.+?)\s*\((\d{4})\)\s*(.+?)\.\s*([A-Z][\w\s&:,\-]+?)\s+(\d+)"
    r"(?:\((\d+)\))?\s*[:\-,]\s*([\d\-–]+)"
)
SIMPLE_JOURNAL = (
    r"^(.+?)\s*\((\d{4})\)\.\s*(.+?)\.\s*([A-Z][\w\s&:,]+?),\s*(\d+)(?:\((\d+)\))?,\s*([\d\-–]+)\."
    r"(?:\s*(?:https?://)?doi\.org/(.+?))?\.?\s*$"
)
DOI = r"(?i)(?:https?://)?doi\.org/(10\.\d{4,}/\S+)"
AND_SPLIT = r",\s*&\s*|,\s*and\s*|\s+&\s+|\s+and\s+"
INITIALS = r"^[A-Z]\.(?:\s*[A-Z]\.)*$"
TRAILING_INITIALS = r"^(\S+(?:\s+\S+)*?)((?:\s+[\p{Lu}.]+)+)$"

PARENTHETICAL_TYPE, NARRATIVE_TYPE = "parenthetical", "narrative"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.expr(SPACES))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is read."""
    return F.transform(F.array(value), use)[0]


#: Items of a block in a fold that gathers an array: appending copies one block at most.
BLOCK = 128


def gathered(items: Column, state: dict[str, Column], kind: str, step) -> Column:
    """One fold over ``items`` that emits an element or null for each and carries ``state``.

    ``step(state, item)`` gives the next state and the element.  Elements are gathered in blocks,
    so a fold over n items copies n * BLOCK elements, not n squared.
    """
    names = list(state)
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(*[c.alias(n) for n, c in state.items()], none.alias("_block"), F.array().cast(f"array<array<{kind}>>").alias("_done"))

    def merge(acc: Column, item: Column) -> Column:
        after, element = step(acc, item)
        full = F.size(acc["_block"]) >= BLOCK
        opened = F.when(full, none).otherwise(acc["_block"])
        done = F.when(full, F.array_append(acc["_done"], acc["_block"])).otherwise(acc["_done"])
        opened = F.when(element.isNull(), opened).otherwise(F.array_append(opened, element))
        return F.struct(*[after[n].alias(n) for n in names], opened.alias("_block"), done.alias("_done"))

    return F.aggregate(items, start, merge, lambda acc: F.flatten(F.array_append(acc["_done"], acc["_block"])))


def _spans(s: Column, pattern: str) -> Column:
    """Matches with their 0-based start and the 8 characters before: array of ``(m, start, before)``."""
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    between = F.split(s, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        start, before = acc["at"] + F.length(p["gap"]), F.right(F.concat(acc["tail"], p["gap"]), F.lit(8))
        after = {"at": start + F.length(p["m"]), "tail": F.right(F.concat(before, p["m"]), F.lit(8))}
        return after, F.struct(p["m"].alias("m"), start.alias("start"), before.alias("before"))

    kind = "struct<m: string, start: int, before: string>"
    spans = gathered(pairs, {"at": F.lit(0), "tail": F.lit("")}, kind, step)
    # Most texts have no match; for them the fold is left out.
    return F.when(s.isNull() | F.rlike(s, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{kind}>"))


CITATION = "struct<text: string, citation_type: string, author: string, year: string, start: int, end: int>"


def _citation(text, kind, author, year, start, end) -> Column:
    return F.struct(
        text.alias("text"),
        F.lit(kind).alias("citation_type"),
        author.cast("string").alias("author"),
        year.cast("string").alias("year"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
    )


def _first_author(names: Column) -> Column:
    return py_strip(F.split(F.split(names, " & ").getItem(0), " and ").getItem(0))


def numeric_citations(s: Column) -> Column:
    """O-C1: ``(1)``, ``(2, 3)``, ``(4-6)``, unless after a figure, table or equation word."""
    null = F.lit(None)
    kept = F.filter(
        _spans(s, NUMERIC),
        lambda r: ~F.rlike(r["before"], F.lit(CROSS_REFERENCE)),
    )
    return F.transform(
        kept,
        lambda r: _citation(
            r["m"], PARENTHETICAL_TYPE, null, null, r["start"], r["start"] + F.length(r["m"])
        ),
    )


def parenthetical_citations(s: Column) -> Column:
    """O-C2: one citation per ``;``-separated part of ``(Smith, 2023; Doe, 2021)``."""

    def parts(r: Column) -> Column:
        inner = F.substring(r["m"], F.lit(2), F.length(r["m"]) - 2)
        pieces = F.filter(
            F.transform(F.split(inner, ";"), py_strip), lambda p: F.rlike(p, F.lit(PART))
        )
        return F.transform(
            pieces,
            lambda p: _citation(
                F.concat(F.lit("("), p, F.lit(")")),
                PARENTHETICAL_TYPE,
                _first_author(F.regexp_extract(p, PART, 1)),
                F.regexp_extract(p, PART, 2),
                r["start"],
                r["start"] + F.length(r["m"]),
            ),
        )

    return F.flatten(F.transform(_spans(s, PARENTHETICAL), parts))


def narrative_citations(s: Column) -> Column:
    """O-C3 before the overlap test: ``Smith (2023)``."""

    def one(r: Column) -> Column:
        names = F.regexp_extract(r["m"], NARRATIVE, 1)
        year = F.regexp_extract(r["m"], NARRATIVE, 2)
        return _citation(
            F.concat(names, F.lit(" ("), year, F.lit(")")),
            NARRATIVE_TYPE,
            _first_author(names),
            year,
            r["start"],
            r["start"] + F.length(r["m"]),
        )

    return F.transform(_spans(s, NARRATIVE), one)


def drop_overlaps(narrative: Column, earlier: Column, contained: bool = False) -> Column:
    """Narrative citations outside every earlier span.

    By default one that starts inside a span is dropped; with ``contained`` only one
    that lies wholly inside.
    """

    # In the order of starts, the furthest end so far tells whether any span reaches over one.
    def marked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end"), c.alias("c")))

    def step(acc: Column, e: Column) -> tuple[dict[str, Column], Column]:
        reached = acc["furthest"] >= e["end"] if contained else acc["furthest"] > e["start"]
        after = {"furthest": F.when(e["kind"] == 0, F.greatest(acc["furthest"], e["end"])).otherwise(acc["furthest"])}
        return after, F.when((e["kind"] == 1) & ~reached, e["c"])

    def outside(both: Column) -> Column:
        before, late = both["earlier"], both["narrative"]
        in_order = F.array_sort(F.concat(marked(before, 0), marked(late, 1)))
        kept = gathered(in_order, {"furthest": F.lit(-1)}, CITATION, step)
        # Narrative citations are in the order of their starts already.
        return F.when((F.size(before) == 0) | (F.size(late) == 0), late).otherwise(kept)

    return bound(F.struct(earlier.alias("earlier"), narrative.alias("narrative")), outside)


@sql_function("text STRING", "ARRAY<INT>")
def expand_citation_numbers(text):
    """O-C5: the numbers a citation names, ranges written out."""
    a = f"cast(regexp_extract(p, {raw('^([0-9]+)[-–]')}, 1) as int)"
    b = f"cast(regexp_extract(p, {raw('^[0-9]+[-–]([0-9]+)')}, 1) as int)"
    none = "cast(array() as array<int>)"
    return (
        f"flatten(transform(split(btrim({text}, '()[] '), {raw('[,;\\s]+')}), p -> case "
        f"when p rlike {raw('^[0-9]+[-–][0-9]+')} then if({a} <= {b}, sequence({a}, {b}), {none}) "
        f"when p rlike '^[0-9]+$' then array(cast(p as int)) else {none} end))"
    )


@sql_function("a STRING, b STRING", "INT")
def indel_ratio(a, b):
    """O-J5: 0-100 similarity from the longest common subsequence, halves to even.

    The subsequence is counted by bit vectors: of ``a``, 32 characters are a block of bits, and each
    character has a mask of its places.  A character of ``b`` changes all blocks by one addition
    with carry; places that end as 0 are in the subsequence.
    """
    full = "4294967295L"
    places = "aggregate(sequence(1, length(s)), 0L, (x, i) -> if(substr(s, i, 1) = c, x | shiftleft(1L, i - 1), x))"
    masks = f"map_from_entries(transform(array_distinct(split({a}, '')), c -> struct(c, transform(blocks, s -> {places}))))"
    added = "v[k] + (v[k] & at[k]) + acc.carry"
    block = f"(({added}) & {full}) | (v[k] & ~at[k])"
    moved = (
        "aggregate(sequence(0, size(v) - 1), struct(cast(array() as array<bigint>) as v, 0L as carry), "
        f"(acc, k) -> struct(array_append(acc.v, {block}) as v, shiftright({added}, 32) as carry), acc -> acc.v)"
    )
    step = f"if(map_contains_key(mask, ch), transform(array(mask[ch]), at -> {moved})[0], v)"
    fold = f"aggregate(split({b}, ''), transform(blocks, s -> {full}), (v, ch) -> {step})"
    left = "aggregate(zip_with(v, blocks, (x, s) -> length(s) - bit_count(x & (shiftleft(1L, length(s)) - 1))), 0, (n, x) -> n + x)"
    count = f"transform(array({masks}), mask -> transform(array({fold}), v -> {left})[0])[0]"
    blocks = f"transform(sequence(0, (length({a}) - 1) div 32), k -> substr({a}, cast(32 * k + 1 as int), 32))"
    lcs = f"transform(array({blocks}), blocks -> {count})[0]"
    return (
        f"case when length({a}) = 0 or length({b}) = 0 then if(length({a}) = length({b}), 100, 0) "
        f"else cast(bround(200.0D * {lcs} / (length({a}) + length({b})), 0) as int) end"
    )


def _comma_name(part: Column) -> Column:
    has = part.contains(",")
    return F.struct(
        F.when(has, py_strip(F.regexp_extract(part, r"(?s)^([^,]*),", 1))).otherwise(part).alias("family"),
        F.when(has, py_strip(F.regexp_extract(part, r"(?s)^[^,]*,(.*)$", 1))).alias("given"),
    )


def _tidy(part: Column) -> Column:
    return py_strip(F.rtrim(py_strip(part), F.lit(",")))


def _is_et_al(part: Column) -> Column:
    return F.lower(part).startswith("et al")


def parse_authors(s: Column) -> Column:
    """O-C9: author string to ``array<struct<family, given>>``.

    ``&``, `` and `` or initials with dots after a comma mean names are split at the
    conjunctions only; otherwise at commas, trailing capitals being the given name.
    """
    commas = F.transform(F.split(s, ","), py_strip)
    conjunction = s.contains("&") | F.lower(s).contains(" and ")
    dotted = F.exists(F.slice(commas, 2, F.size(commas)), lambda p: F.rlike(p, F.lit(INITIALS)))
    by_conjunction = F.filter(
        F.transform(
            F.filter(F.transform(F.split(s, AND_SPLIT), _tidy), lambda p: (p != "") & ~_is_et_al(p)),
            _comma_name,
        ),
        lambda n: n["family"] != "",
    )

    def trailing(p: Column) -> Column:
        hit = F.rlike(p, F.lit(TRAILING_INITIALS))

        def squeezed(g: int) -> Column:
            return F.regexp_replace(
                py_strip(F.regexp_extract(p, TRAILING_INITIALS, g)), SPACE_RUN, " "
            )

        return F.struct(
            F.when(hit, squeezed(1)).otherwise(p).alias("family"), F.when(hit, squeezed(2)).alias("given")
        )

    by_comma = F.transform(F.filter(commas, lambda p: (p != "") & ~_is_et_al(p)), trailing)
    chosen = F.when(conjunction | dotted, by_conjunction).otherwise(by_comma)
    return F.coalesce(chosen, F.array().cast(f"array<{AUTHOR}>"))


def parse_authors_simple(s: Column) -> Column:
    """Names split at conjunctions only, family and given at the first comma."""
    parts = F.filter(F.transform(F.split(s, AND_SPLIT), _tidy), lambda p: p != "")
    return F.coalesce(F.transform(parts, _comma_name), F.array().cast(f"array<{AUTHOR}>"))
