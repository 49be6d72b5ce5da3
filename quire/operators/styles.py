"""Style specifications as data: merge, repair, compare, resolve (O-Y1..Y6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalise_guideline
from quire.sources.styles import FALLBACK_STYLE, SECTIONS, leaf_paths, with_defaults

__all__ = [
    "compare_specs",
    "compare_styles",
    "deep_merge",
    "flatten_specs",
    "heading_level_spec",
    "heading_specs",
    "nest_leaves",
    "recover_sections",
    "resolve_style",
    "with_defaults",
]

MIN_GUIDELINE = 50


def flatten_specs(specs: DataFrame) -> DataFrame:
    """``(style_id, path, value)``: one row per leaf, values as text."""
    leaves = F.array(
        *[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p, _, _ in leaf_paths()]
    )
    return specs.select("style_id", F.inline(leaves))


def nest_leaves(leaves: DataFrame) -> DataFrame:
    """Leaf rows back to nested specifications with defaults."""
    key = F.col("style_id").alias("_key")
    wide = leaves.select(key, "path", "value").groupBy("_key").pivot(
        "path", [p for p, _, _ in leaf_paths()]
    ).agg(F.first("value"))

    def build(entries: list, prefix: str) -> list:
        groups: dict[str, list] = {}
        for path, kind, _ in entries:
            groups.setdefault(path.split(".")[0], []).append((path, kind))
        out = []
        for head, items in groups.items():
            if items[0][0] == head:
                out.append(F.col(f"`{prefix}{head}`").cast(items[0][1]).alias(head))
            else:
                inner = [(p.split(".", 1)[1], k, None) for p, k in items]
                out.append(F.struct(*build(inner, f"{prefix}{head}.")).alias(head))
        return out

    return with_defaults(wide.select(*build(leaf_paths(), "")))


def deep_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """O-Y2 on leaf rows: non-null leaves of ``override`` replace those of ``base``."""
    o = override.select("style_id", "path", F.col("value").alias("_value"))
    joined = base.join(o, ["style_id", "path"], "full_outer")
    return joined.select("style_id", "path", F.coalesce("_value", "value").alias("value"))


def recover_sections(documents: DataFrame, column: str = "json") -> DataFrame:
    """O-Y3: JSON specifications; a section with an invalid leaf is replaced by its defaults."""
    valid: dict[str, list] = {}
    doc = F.col("_doc")
    for path, kind, _ in leaf_paths():
        parts = path.split(".")
        at = "$." + path
        kind_there = F.schema_of_variant(F.try_variant_get(doc, at, "variant"))
        text = F.try_variant_get(doc, at, "string")
        absent = text.isNull() | (kind_there == "VOID")
        if kind == "string":
            ok = absent | (kind_there == "STRING")
        else:
            ok = absent | F.expr(f"try_cast(try_variant_get(_doc, '{at}', 'string') as {kind}) is not null")
        valid.setdefault(parts[0], []).append(F.coalesce(ok, F.lit(True)))
    df = documents.withColumn("_doc", F.try_parse_json(F.col(column)))
    cols = []
    for section, checks in valid.items():
        good = checks[0]
        for ok in checks[1:]:
            good = good & ok
        if section in SECTIONS:
            shape = F.schema_of_variant(F.try_variant_get(doc, f"$.{section}", "variant"))
            good = good & F.coalesce(shape.startswith("OBJECT"), F.lit(True))
        cols.append((section, good))

    def build(entries: list, prefix: str, keep) -> list:
        groups: dict[str, list] = {}
        for path, kind in entries:
            groups.setdefault(path.split(".")[0], []).append((path, kind))
        out = []
        for head, items in groups.items():
            if items[0][0] == head:
                value = F.expr(
                    f"try_cast(try_variant_get(_doc, '$.{prefix}{head}', 'string') as {items[0][1]})"
                )
                out.append(F.when(keep, value).alias(head))
            else:
                inner = [(p.split(".", 1)[1], k) for p, k in items]
                out.append(F.struct(*build(inner, f"{prefix}{head}.", keep)).alias(head))
        return out

    flags = df.select("_doc", *[g.alias(f"_ok_{s}") for s, g in cols])
    built = []
    for section, _ in cols:
        entries = [(p, k) for p, k, _ in leaf_paths() if p.split(".")[0] == section]
        built += build(entries, "", F.col(f"_ok_{section}"))
    return with_defaults(flags.select(*built))


def _differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a = left.select(*keys, F.col("value").alias("a"))
    b = right.select(*keys, F.col("value").alias("b"))
    return a.join(b, keys, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def compare_specs(left: DataFrame, right: DataFrame) -> DataFrame:
    """O-Y4: ``(style_id, path, a, b)`` where two sets of specifications differ."""
    return _differences(flatten_specs(left), flatten_specs(right), ["style_id", "path"])


def compare_styles(specs: DataFrame, a: str, b: str) -> DataFrame:
    """O-Y4 for two styles of one set: ``(path, a, b)``."""
    leaves = flatten_specs(specs)
    left, right = (leaves.filter(F.col("style_id") == s) for s in (a, b))
    return _differences(left, right, ["path"])


def resolve_style(requests: DataFrame, interpreted: DataFrame, specs: DataFrame) -> DataFrame:
    """O-Y5: which specification each request gets.

    ``requests(request_id, style_id, guidelines_text, url_text)``; ``interpreted(request_id,
    spec_id)`` holds what an outside service made of a text or page.  Text comes before a
    page, a page before the style id; a page under 50 characters, or one nothing was made
    of, falls back to the built-in style, and an unknown id to apa7.
    """
    text = F.trim(F.coalesce("guidelines_text", F.lit(""))) != ""
    page = F.length(normalise_guideline("url_text")) >= MIN_GUIDELINE
    wants = F.when(text, "text").when(F.coalesce(page, F.lit(False)), "url").otherwise("style")
    known = specs.select(F.col("style_id").alias("_known"))
    df = (
        requests.withColumn("_wants", wants)
        .join(interpreted, "request_id", "left")
        .join(known, F.col("style_id") == F.col("_known"), "left")
    )
    use = (F.col("_wants") != "style") & F.col("spec_id").isNotNull()
    return df.select(
        "request_id",
        F.when(use, F.col("_wants")).otherwise("style").alias("source"),
        F.when(use, F.col("spec_id"))
        .otherwise(F.coalesce("_known", F.lit(FALLBACK_STYLE)))
        .alias("spec_id"),
    )


def in_styles(rows: DataFrame, doc_styles: DataFrame, dimension: DataFrame, *keys: str) -> DataFrame:
    """Rows of documents with the rules of the style each document is set in.

    ``doc_styles(doc_id, style_id)`` says which: one row per document, or several where a
    document is wanted in several styles.  A document without a row is set in apa7, as is one of
    an unknown style after ``known_styles``.  Both joins are on keys, and whether the rules are
    small enough to broadcast is left to their size.
    """
    assigned = rows.join(doc_styles.select("doc_id", "style_id"), "doc_id", "left")
    assigned = assigned.withColumn("style_id", F.coalesce("style_id", F.lit(FALLBACK_STYLE)))
    return assigned.join(dimension, ["style_id", *keys])


def known_styles(doc_styles: DataFrame, specs: DataFrame) -> DataFrame:
    """The assignment with apa7 instead of styles that no specification has."""
    known = specs.select(F.col("style_id").alias("_known"))
    found = doc_styles.join(known, F.col("style_id") == F.col("_known"), "left")
    return found.select("doc_id", F.coalesce("_known", F.lit(FALLBACK_STYLE)).alias("style_id"))


def every_style(documents: DataFrame, style_ids: list[str]) -> DataFrame:
    """The assignment of every document to each of the named styles."""
    ids = F.explode(F.array(*[F.lit(s) for s in style_ids])).alias("style_id")
    return documents.select("doc_id").distinct().select("doc_id", ids)


def heading_specs(specs: DataFrame) -> DataFrame:
    """Heading levels unpivoted: ``(style_id, level, alignment, …)``."""
    levels = F.array(
        *[F.struct(F.lit(n).alias("level"), F.col(f"headings.level_{n}").alias("h")) for n in range(1, 6)]
    )
    return specs.select("style_id", F.inline(levels)).select("style_id", "level", "h.*")


def heading_level_spec(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """O-Y6: ``requests(style_id, level)`` with the level's rules; levels outside 1-5 read as 1."""
    wanted = F.when(F.col("level").between(1, 5), F.col("level")).otherwise(1)
    rules = heading_specs(specs).withColumnRenamed("level", "used_level")
    return requests.withColumn("used_level", wanted).join(rules, ["style_id", "used_level"])
