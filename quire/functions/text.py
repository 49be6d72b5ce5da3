"""Text cleanup functions (O-T1..T12)."""

from __future__ import annotations

from quire.functions.base import SPACE_RUN, SPACES, WORD, raw, sql_function, strip, words

# Zero-width and format code points removed from element content.
INVISIBLE_CODES = (
    "200b", "200c", "200d", "200e", "200f", "feff", "00ad", "2028", "2029", "034f", "061c", "180e",
    "fff9", "fffa", "fffb",
)
INVISIBLE = "'" + "".join(f"\\u{c}" for c in INVISIBLE_CODES) + "'"

# Minor words of the two title-case rules.
APA_MINOR_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "for", "if", "in", "nor", "of", "on", "or", "so",
    "the", "to", "up", "yet",
]
HEADING_MINOR_WORDS = [
    "a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "in", "of", "up",
    "as", "is", "if", "it", "vs", "via", "so", "yet",
]

# Fixed value: numbering in front of a heading.
HEADING_NUMBER = r"^(?:[IVXLC]+[.)]\s*|[A-Za-z][.)]\s*|\d+[.)]\s*)"


def _in(word: str, choices: list[str]) -> str:
    return f"{word} in ({', '.join(repr(c) for c in choices)})"


def capitalise(w: str) -> str:
    # A sharp s opens a word as "Ss".
    return f"concat(replace(upper(left({w}, 1)), 'SS', 'Ss'), lower(substr({w}, 2)))"


def all_caps(w: str) -> str:
    return f"(upper({w}) = {w} and lower({w}) <> {w})"


@sql_function("s STRING", "STRING")
def strip_invisible(s):
    """Delete zero-width and format characters; none of them is ASCII."""
    return f"if(octet_length({s}) = char_length({s}), {s}, translate({s}, {INVISIBLE}, ''))"


@sql_function("s STRING", "STRING")
def strip_artifacts(s):
    """Delete conversion artifacts and trim both ends."""
    return strip(f"translate({s}, '\\u200b\\u200f\\ufeff\\u00ad', '')")


@sql_function("s STRING", "STRING")
def clean_text(s):
    """Drop control characters, squeeze spaces, trim."""
    bare = f"regexp_replace({s}, {raw('[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')}, '')"
    return strip(f"regexp_replace({bare}, ' +', ' ')")


@sql_function("s STRING", "STRING")
def normalise_guideline(s):
    """At most one blank line in a row; no drawn rules."""
    fewer = f"regexp_replace({s}, {raw('\\n{3,}')}, '\\n\\n')"
    return strip(f"regexp_replace({fewer}, '[═─━]{{5,}}', '')")


@sql_function("s STRING", "INT")
def word_count(s):
    """Number of tokens between white space."""
    return f"regexp_count({s}, {raw(WORD)})"


@sql_function("s STRING, n INT", "STRING")
def truncate_text(s, n="50"):
    """Cut to n characters, the last three of them dots, only if longer."""
    return f"if(length({s}) <= {n}, {s}, concat(left({s}, {n} - 3), '...'))"


def _cased(s: str, inner: str, last: str) -> str:
    """Words joined after ``inner`` (over w, i) on all but the last and ``last`` (over w) on it."""
    tokens = words(s)
    head = f"slice({tokens}, 1, greatest(size({tokens}) - 1, 0))"
    tail = f"slice({tokens}, greatest(size({tokens}), 1), 1)"
    return f"array_join(concat(transform({head}, (w, i) -> {inner}), transform({tail}, w -> {last})), ' ')"


@sql_function("s STRING", "STRING")
def apa_title_case(s):
    """Title case with minor words lowered unless first or last."""
    minor = f"i > 0 and {_in("lower(btrim(w, '.:;,!?()'))", APA_MINOR_WORDS)}"
    return _cased(s, f"case when {minor} then lower(w) else {capitalise('w')} end", capitalise("w"))


@sql_function("s STRING, mode STRING", "STRING")
def text_case(s, mode):
    """Heading case: upper, title_case or sentence_case; abbreviations kept."""
    keep = f"length(w) > 1 and {all_caps('w')}"
    kept = f"case when {keep} then w else {capitalise('w')} end"
    minor = f"i > 0 and {_in('lower(w)', HEADING_MINOR_WORDS)}"
    title = _cased(s, f"case when {minor} then lower(w) else {kept} end", kept)
    sentence = (
        f"array_join(transform({words(s)}, (w, i) -> case when i = 0 then {capitalise('w')} "
        f"when {keep} then w else lower(w) end), ' ')"
    )
    return (
        f"case when {s} = '' then {s} when {mode} = 'upper' then upper({s}) "
        f"when {mode} = 'title_case' then {title} "
        f"when {mode} = 'sentence_case' and length({s}) <= 1 then upper({s}) "
        f"when {mode} = 'sentence_case' then {sentence} else {s} end"
    )


# English Metric Units per inch and per point.
@sql_function("x DOUBLE", "BIGINT")
def inches_to_emu(x):
    """Inches to EMU, truncated toward zero."""
    return f"cast({x} * 914400 as bigint)"


@sql_function("x DOUBLE", "BIGINT")
def pt_to_emu(x):
    """Points to EMU, truncated toward zero."""
    return f"cast({x} * 12700 as bigint)"


@sql_function("x BIGINT", "DOUBLE")
def emu_to_inches(x):
    """EMU to inches, 3 decimals."""
    return f"bround({x} / 914400, 3)"


@sql_function("x BIGINT", "DOUBLE")
def emu_to_pt(x):
    """EMU to points, 1 decimal."""
    return f"bround({x} / 12700, 1)"


@sql_function("html STRING", "STRING")
def strip_html(html):
    """Page text: non-content blocks and tags removed, white space collapsed."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        out = f"regexp_replace({out}, {raw(f'(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>')}, ' ')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ')"
    return strip(f"regexp_replace({out}, {raw(SPACE_RUN)}, ' ')")


@sql_function("s STRING", "STRING")
def strip_heading_number(s):
    """Remove one leading heading number."""
    return strip(f"regexp_replace({s}, {raw(HEADING_NUMBER)}, '')")


@sql_function("s STRING", "STRING")
def strip_json_fence(s):
    """JSON text without a surrounding code fence."""
    opened = (
        f"case when not startswith({s}, '```') then {s} "
        f"when contains({s}, '\\n') then substr({s}, instr({s}, '\\n') + 1) "
        f"else substr({s}, 4) end"
    )
    return strip(f"regexp_replace({opened}, {raw('```\\z')}, '')")


__all__ = [
    "APA_MINOR_WORDS",
    "HEADING_MINOR_WORDS",
    "SPACES",
    "apa_title_case",
    "clean_text",
    "emu_to_inches",
    "emu_to_pt",
    "inches_to_emu",
    "normalise_guideline",
    "pt_to_emu",
    "strip_artifacts",
    "strip_heading_number",
    "strip_html",
    "strip_invisible",
    "strip_json_fence",
    "text_case",
    "truncate_text",
    "word_count",
]
