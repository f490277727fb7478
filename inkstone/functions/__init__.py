"""Text normalisation as SQL expressions: everything runs inside the engine's generated code."""

from __future__ import annotations

from ..plans.dialect import Spark

QUOTES = ("“”‘’「」『』„‚«»", "\"\"''\"\"''\"'\"\"")
MARKS = ("，。；：？！（）、—–‐‑−－【】《》", ",.;:?!(),-----" + "-[]<>")
SPACE = r"(?U)[\s\u001c-\u001f]+"


def invisible(d: Spark, x: str) -> str:
    """Without format characters: soft hyphens, zero-width spaces, byte-order marks."""
    return d.every(x, r"\p{Cf}")


def _space(d: Spark) -> str:
    return SPACE if d.name == "spark" else r"\s+"


def _quoted(d: Spark, text: str) -> str:
    return "'" + text.replace("'", "\\'" if d.name == "spark" else "''") + "'"


def norm(d: Spark, x: str) -> str:
    """Quotes and punctuation unified, white space collapsed, lower case. Compatibility forms are unified by nfkc() before."""
    mapped = f"replace(translate({invisible(d, x)}, {_quoted(d, QUOTES[0] + MARKS[0])}, {_quoted(d, QUOTES[1] + MARKS[1])}), '…', '...')"
    return f"lower(trim({d.every(mapped, _space(d), ' ')}))"


def compact(d: Spark, x: str) -> str:
    """norm() without white space, of a text that is normalised already."""
    return d.every(x, _space(d))


def plain(d: Spark, x: str) -> str:
    """norm() without white space, punctuation and symbols, of a text that is normalised already."""
    return d.every(x, r"(?U)[\p{P}\p{S}\s]")


def plain_at_once(d: Spark, x: str) -> str:
    """plain(norm()) of a text in one pass, in Spark.

    What norm() unifies is punctuation and white space before and after, so plain() drops it either way. Only a capital sigma becomes
    another letter by what stands around it; texts that have one take both steps. Spaces and line feeds, which are most of what is
    dropped, and letters a to z take the short way.
    """
    bare = f"replace(replace(lower({x}), ' ', ''), {d.newline}, '')"
    return f"CASE WHEN contains({x}, 'Σ') THEN {plain(d, norm(d, x))} ELSE {d.every(bare, r'(?U)[[^a-z0-9]&&[\p{P}\p{S}\p{Cf}\s\u001c-\u001f]]+')} END"


def pdf(d: Spark, x: str) -> str:
    """norm() of a text whose words may be broken at line ends."""
    return norm(d, d.every(x, r"([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def roman(d: Spark, x: str) -> str:
    """The number of a roman numeral from its letters' values; the caller checks that it is canonical."""
    count = lambda p: f"(length({x}) - length(replace({x}, '{p}', ''))) / {len(p)}"
    total = " + ".join(f"{v} * {count(c)}" for c, v in (("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)))
    less = " + ".join(f"{v} * {count(p)}" for p, v in (("iv", 2), ("ix", 2), ("xl", 20), ("xc", 20), ("cd", 200), ("cm", 200)))
    return f"CAST(({total}) - ({less}) AS INT)"


ROMAN = r"^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def int_to_roman(d: Spark, n: str) -> str:
    digit = lambda one, five, ten, unit: f"CASE floor({n} / {unit}) % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])) + " END"
    return f"concat(repeat('m', CAST(floor({n} / 1000) AS INT)), {digit('c', 'd', 'm', 100)}, {digit('x', 'l', 'c', 10)}, {digit('i', 'v', 'x', 1)})"


def nfkc(df, column: str):
    """df with a column in Unicode compatibility form. Only rows that hold a character which that could change pass through Python."""
    import unicodedata

    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    odd = F.coalesce(F.col(column).rlike(r"[^\x00-\x7fÀ-ÿ]"), F.lit(False))
    return df.where(~odd).unionByName(df.where(odd).withColumn(column, form(column)))
