"""Functions written once as SQL expressions, used from DataFrames and from SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The white space that Python's str.strip and str.split remove.
SPACE_CODES = (
    "0020", "0009", "000a", "000b", "000c", "000d", "001c", "001d", "001e", "001f", "0085", "00a0",
    "1680", "2000", "2001", "2002", "2003", "2004", "2005", "2006", "2007", "2008", "2009", "200a",
    "2028", "2029", "202f", "205f", "3000",
)
SPACES = "'" + "".join(f"\\u{c}" for c in SPACE_CODES) + "'"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)[^\s\x1c-\x1f]+"


def raw(pattern: str) -> str:
    """A regular expression as a raw SQL string literal."""
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"'


def strip(s: str) -> str:
    return f"btrim({s}, {SPACES})"


def strip_column(s: str) -> str:
    """``strip`` of a plain column: ASCII text that neither starts nor ends with white space stays as it is."""
    whole = f"octet_length({s}) = char_length({s}) and left({s}, 1) > ' ' and right({s}, 1) > ' '"
    return f"if({whole}, {s}, {strip(s)})"


def words(s: str) -> str:
    return f"filter(split({s}, {raw(SPACE_RUN)}), w -> w <> '')"


def every_script(pattern: str) -> str:
    """The pattern with word, digit and space classes of all scripts, and ``.`` up to a newline only."""
    return "(?Ud)" + pattern


def matches(s: str, pattern: str) -> str:
    return f"({s} rlike {raw(every_script(pattern))})"


class SqlFunction:
    """A named SQL expression: call it for a Column, or register it as a SQL function."""

    registry: dict[str, SqlFunction] = {}

    def __init__(self, build: Callable[..., str], params: str, returns: str):
        self.build, self.params, self.returns = build, params, returns
        self.name, self.__doc__ = build.__name__, build.__doc__
        SqlFunction.registry[self.name] = self

    def sql(self, *args: object) -> str:
        """The expression over column names or SQL expressions."""
        return self.build(*[str(a) for a in args])

    def __call__(self, *args: object) -> Column:
        return F.expr(self.sql(*args))

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        names = [p.split()[0] for p in self.params.split(",")]
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{self.name}({self.params}) "
            f"RETURNS {self.returns} RETURN {self.build(*names)}"
        )


def sql_function(params: str, returns: str):
    return lambda build: SqlFunction(build, params, returns)


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make every text, predicate and citation function callable from SQL (O-X2).

    Catalyst inlines the bodies, so a registered call plans like the expression itself.
    """
    from quire.functions import citation_text, predicates, text  # noqa: F401

    for fn in SqlFunction.registry.values():
        fn.register(spark, prefix)
    return sorted(SqlFunction.registry)
