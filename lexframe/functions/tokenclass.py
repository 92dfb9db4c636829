"""Kind and family of a token from its text, as codegen-friendly Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexframe.functions import patterns as P


def token_kind(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    last = F.substring(text, -1, 1)
    size = F.length(text)
    return (
        F.when(text == P.END_MARK, "EOF")
        .when(text.isin(P.KEYWORDS + P.WORD_LITERALS), F.upper(text))
        .when(text.isin([d for d in P.OPERATORS + P.DELIMITERS]), text)
        .when(first.rlike("[A-Za-z$_]") | ((first == "\\") & (size > 1)), "IDENTIFIER")
        .when(first.between("0", "9") | (first == "."), "NUMBER")
        .when(first.isin('"', "'"), "STRING")
        .when((first == "`") & (size > 1), F.when(last == "`", "TEMPLATE_NO_SUB").otherwise("TEMPLATE_HEAD"))
        .when(first == "}", F.when(last == "`", "TEMPLATE_TAIL").otherwise("TEMPLATE_MIDDLE"))
        .when(first == "/", "REGEX")
        .otherwise("ERROR")
    )


def token_family(kind: Column) -> Column:
    literals = [w.upper() for w in P.WORD_LITERALS] + ["NUMBER", "STRING", "REGEX"]
    return (
        F.when(kind.isin([k.upper() for k in P.KEYWORDS]), "keyword")
        .when(kind.isin(literals), "literal")
        .when(kind == "IDENTIFIER", "identifier")
        .when(kind.startswith("TEMPLATE"), "template")
        .when(kind.isin(P.OPERATORS), "operator")
        .when(kind.isin(P.DELIMITERS), "delimiter")
        .otherwise("special")
    )


def number_value(text: Column) -> Column:
    """Hex by base 16; anything else as written in decimal, so a legacy octal 017 is 17."""
    hexa = F.conv(F.substring(text, 3, 2**31 - 1), 16, 10).try_cast("double")
    return F.when(F.lower(F.substring(text, 1, 2)) == "0x", hexa).otherwise(text.try_cast("double"))


def unquote(text: Column) -> Column:
    """Drops the first and last character of a quoted text of two or more characters."""
    return F.when(F.length(text) >= 2, F.expr("substring(text, 2, length(text) - 2)")).otherwise(text)
