"""Formatting tables for the derived manuscripts, by arithmetic on ``doc_id`` and ``idx``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.sources.style_values import STYLES
from quire.sources.styles import leaf_paths

# Each statement reads ``lines(doc_id, idx, content)`` and is the same text in both engines.
TABLES = {
    "sections": """select doc_id, 0 as section_no,
      case when doc_id % 7 = 0 then 0.75 else 1.0 end as "top", 1.0 as "bottom",
      case when doc_id % 5 = 0 then 1.25 else 1.0 end as "left", 1.0 as "right" from lines where idx = 0""",
    "doc_defaults": """select doc_id, case when doc_id % 3 = 0 then 'Arial' else 'Times New Roman' end as font_name,
      case when doc_id % 11 = 0 then null when doc_id % 4 = 0 then 10.0 else 12.0 end as font_size_pt,
      case when doc_id % 13 = 0 then null when doc_id % 2 = 0 then 2.0 else 1.0 end as line_spacing from lines where idx = 0""",
    "paragraph_format": """select doc_id, idx,
      case (doc_id + idx) % 4 when 0 then 'center' when 1 then 'left' when 2 then 'justify' else null end as alignment,
      case when idx >= 12 and doc_id % 3 <> 1 then -0.5 when doc_id % 6 = 0 then 0.5 else null end as first_line_indent,
      case when idx >= 12 and doc_id % 3 <> 2 then 0.5 else null end as left_indent,
      2.0 as line_spacing from lines""",
    "runs": """select doc_id, idx, 0 as run_no, content as text,
      case when idx in (0, 3, 6) then doc_id % 2 = 0 else null end as bold, false as italic,
      case when (doc_id + idx) % 9 = 0 then 'Arial' when doc_id % 3 = 0 then null else 'Times New Roman' end as font_name,
      case when doc_id % 8 = 0 then 14.0 when doc_id % 10 = 3 then 24.0 else 12.0 end as font_size_pt from lines""",
    "changes": """select doc_id, case idx when 0 then 'title_page' when 3 then 'abstract' when 6 then 'headings'
        when 8 then 'tables_figures' else 'references' end as category,
      case when doc_id % 17 = 0 then 'warning' when doc_id % 19 = 0 then 'error' else 'info' end as severity,
      content as description, 'applied' as status
      from lines where (idx in (0, 3, 8, 9) or (idx = 6 and doc_id % 5 <> 2)) and doc_id % 23 <> 0""",
}


def tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The formatting tables as DataFrames, with numbers as doubles."""
    out = {}
    for name, sql in TABLES.items():
        # Selected from ``lines`` itself: a view of it would drop its cache with the view.
        fields, _, condition = sql.replace('"', "`").removeprefix("select ").partition(" from lines")
        df = lines.filter(condition.strip().removeprefix("where ")) if condition.strip() else lines
        df = df.selectExpr(*_fields(fields))
        decimals = [f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"]
        out[name] = df.withColumns({c: df[c].cast("double") for c in decimals}) if decimals else df
    return out


def _fields(text: str) -> list[str]:
    """The fields of a select list, split at the commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def styles_values_sql(paths: dict[str, str]) -> str:
    """A ``select`` of the wanted leaves of the built-in styles: ``{column: path}``."""
    defaults = {p: d for p, _, d in leaf_paths()}

    def literal(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return f"cast({v} as double)" if isinstance(v, float) else str(v)
        return "'" + v.replace("'", "''") + "'"

    rows = []
    for style_id, leaves in STYLES.items():
        vals = [literal(style_id)] + [literal(leaves.get(p, defaults[p])) for p in paths.values()]
        rows.append("(" + ", ".join(vals) + ")")
    return f"select * from (values {', '.join(rows)}) as t(style_id, {', '.join(paths)})"
