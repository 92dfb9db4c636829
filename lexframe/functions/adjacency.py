"""Which tokens may stand next to each other: a table of legal pairs made from rules.

The classes are coarse and the rules permissive: a pair is left out only where no script can have it.
"""

from __future__ import annotations

from lexframe.functions import patterns as P

CONTEXTUAL = ["of", "from", "as", "get", "set", "static"]
ASSIGN = [o for o in P.OPERATORS if o.endswith("=") and o not in ("=", "==", "!=", "===", "!==", "<=", ">=")]
_NOT_INFIX = ASSIGN + ["=", "=>", "...", "++", "--", "+", "-", "*", "!", "~", "?", ":"]
INFIX = [o for o in P.OPERATORS if o not in _NOT_INFIX] + ["INSTANCEOF"]
DECLARE = ["VAR", "LET", "CONST"]
PREFIX = ["!", "~", "TYPEOF", "DELETE", "VOID"]
WORDS = [w.upper() for w in P.KEYWORDS + P.WORD_LITERALS]

_NAMES = {"NAME"} | {c.upper() for c in CONTEXTUAL}
_PRIMARY = _NAMES | {"LITERAL", "STRING", "SELF", "TEMPLATE"}
_START = _PRIMARY | {"(", "[", "{", "FUNCTION", "CLASS", "NEW", "ASYNC", "AWAIT", "YIELD", "PREFIX", "SIGN", "UPDATE"}
_PAREN_WORDS = {"IF", "WHILE", "SWITCH", "WITH"}
_SIMPLE = {"RETURN", "THROW", "BREAK", "CONTINUE", "DEBUGGER"}
_STATEMENT = _START | _PAREN_WORDS | _SIMPLE | {"DECLARE", "FOR", "DO", "TRY", "IMPORT", "EXPORT", ";"}
_CONTINUE = {
    "INFIX", "SIGN", "*", "IN", "=", "ASSIGN", "?", ":", ",", ";", ")", "]", "}", ".", "(", "[", "UPDATE",
    "TEMPLATE", "TEMPLATE_END",
}
_KEY = _NAMES | {"STRING", "LITERAL", "[", "*", "ASYNC"}
RIGHT = _STATEMENT | _CONTINUE | {"=>", "...", "ELSE", "CASE", "DEFAULT", "CATCH", "FINALLY", "EXTENDS", "EOF", "PROPERTY"}


def _legal() -> dict[str, set[str]]:
    legal: dict[str, set[str]] = {
        "BOS": _STATEMENT | {"EOF"},
        "NAME": _CONTINUE | {"=>", "OF", "FROM", "AS"},
        "CLASS_NAME": _CONTINUE | {"{", "EXTENDS", "OF", "FROM", "AS"},
        "PROPERTY": _CONTINUE | {"{", "OF", "FROM", "AS"},
        "LITERAL": set(_CONTINUE),
        "STRING": set(_CONTINUE),
        "SELF": set(_CONTINUE),
        "TEMPLATE_END": set(_CONTINUE),
        "CALL": _CONTINUE | {"{", "OF"},
        "]": _CONTINUE | {"{", "OF"},
        "OBJECT": _CONTINUE | {"OF", "FROM"},
        "POSTFIX": set(_CONTINUE) - {"(", "[", ".", "TEMPLATE", "UPDATE", "ASSIGN", "="},
        "CONTROL_HEAD": _STATEMENT | {"EOF"} - {"EOF"},
        "FUNCTION_HEAD": {"{"},
        "ARROW_HEAD": {"=>"},
        "BLOCK": RIGHT - {"=>", "PROPERTY", "OF", "EXTENDS", "..."} | _NAMES,
        "OF": _START | _CONTINUE | {"=>", "OF"},
        "FROM": _CONTINUE | {"=>", "STRING", "OF", "FROM", "AS"},
        "AS": _CONTINUE | _NAMES | {"=>", "DEFAULT"},
        "GET": _CONTINUE | _KEY | {"=>", "OF", "AS"},
        "SET": _CONTINUE | _KEY | {"=>", "OF", "AS"},
        "STATIC": _CONTINUE | _KEY | {"=>", "OF", "AS"},
        "INFIX": set(_START),
        "IN": set(_START),
        "=": set(_START),
        "ASSIGN": set(_START),
        "SIGN": set(_START),
        "PREFIX": set(_START),
        "UPDATE": set(_START),
        "*": _START | {"*"},
        ",": _START | {"...", "}", "]", ",", "DEFAULT", "*"},
        "(": _START | {")", "...", ";", "DECLARE"},
        "[": _START | {"]", ",", "..."},
        "{": _STATEMENT | {"}", "...", "*", "CASE", "DEFAULT"},
        ";": _STATEMENT | {"}", ")", "EOF", "CASE", "DEFAULT", "ELSE", "*"},
        "?": set(_START),
        ":": _STATEMENT | {"}", "CASE", "DEFAULT"},
        "=>": set(_START),
        ".": {"PROPERTY"},
        "...": set(_START),
        "NEW": set(_START),
        "FUNCTION": _NAMES | {"*", "("},
        "CLASS": _NAMES | {"{", "EXTENDS"},
        "EXTENDS": set(_START),
        "ASYNC": _KEY | {"FUNCTION", "("},
        "AWAIT": set(_START),
        "YIELD": _START | {"*", ";", ")", "]", ",", "}", ":", "TEMPLATE_END"},
        "DECLARE": _NAMES | {"[", "{"},
        "FOR": {"(", "AWAIT"},
        "CATCH": {"("},
        "DO": set(_STATEMENT),
        "ELSE": set(_STATEMENT),
        "TRY": {"{"},
        "FINALLY": {"{"},
        "RETURN": _START | {";", "}"},
        "THROW": _START | {";", "}"},
        "BREAK": _NAMES | {";", "}"},
        "CONTINUE": _NAMES | {";", "}"},
        "DEBUGGER": _STATEMENT | {"}", "EOF"},
        "CASE": set(_START),
        "DEFAULT": _START | {":", "AS", ",", "}", ";"},
        "IMPORT": _NAMES | {"{", "*", "STRING"},
        "EXPORT": {"{", "*", "DECLARE", "FUNCTION", "CLASS", "ASYNC", "DEFAULT"},
        "TEMPLATE": set(_START),
    }
    legal.update({w: {"("} for w in _PAREN_WORDS})
    return legal


def legal_pairs() -> list[tuple[str, str]]:
    """All legal (left class, right class) pairs; some hundreds, fixed."""
    return sorted((left, right) for left, rights in _legal().items() for right in rights)


#: Before the name of a method, where any word may stand.
METHOD_LEAD = ["get", "set", "static", "async", "*", ","]
