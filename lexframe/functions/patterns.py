"""Regular expressions of the lexical contract.

Every pattern is written with possessive loops (``*+``, ``++``) whose bodies are runs, so that
``java.util.regex`` neither recurses nor backtracks on long inputs.  ``plain()`` drops the possessive
marks for engines without them; the loops are unambiguous, so both forms match the same text.
None of them uses look-around or back-references.
"""

from __future__ import annotations

#: Appended to every text (after a final newline); becomes the EOF token.
END_MARK = "\x03"

# --- fixed values of the lexical contract -------------------------------------------------------
KEYWORDS = (
    "var let const function if else for while do return break continue switch case default try catch "
    "finally throw new this typeof delete in instanceof void with debugger class extends super import "
    "export yield async await"
).split()

WORD_LITERALS = "true false null undefined".split()

OPERATORS = (
    ">>>= === !== >>> <<= >>= ... => ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= "
    "+ - * / % = < > ! & | ^ ~ ? :"
).split()

DELIMITERS = "( ) { } [ ] ; , .".split()

#: Punctuation after which a slash is still a division.
NO_REGEX_AFTER = ") } ] .".split()
# ------------------------------------------------------------------------------------------------


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$/-" else c for c in text)


def plain(pattern: str) -> str:
    """The same pattern without possessive marks."""
    return pattern.replace("*+", "*").replace("++", "+")


COMMENT = r"(?://[^\n\x03]*+|/[*][^*\x03]*+[*]{1,}(?:[^/*\x03][^*\x03]*+[*]{1,})*+/)"
TRIVIA = rf"(?:[ \t\r\n]++|{COMMENT})*+"

_CLASS = r"\[(?:[^\]\\\r\n\x03]++|\\[^\r\n\x03])*+\]"
REGEX = (
    rf"/(?:[^*/\\\r\n\x03\[]|\\[^\r\n\x03]|{_CLASS})"
    rf"(?:[^/\\\r\n\x03\[]++|\\[^\r\n\x03]|{_CLASS})*+/[gimsuy]*+"
)

NUMBER = (
    r"(?:0[xX][0-9a-fA-F]++|0[0-7]++"
    r"|(?:(?:0|[1-9][0-9]*+)\.[0-9]*+|\.[0-9]++)(?:[eE][+\-]?[0-9]++)?"
    r"|(?:0|[1-9][0-9]*+)[eE][+\-]?[0-9]++|0|[1-9][0-9]*+)"
)

IDENTIFIER = r"(?:[A-Za-z$_]|\\u[0-9a-fA-F]{4})(?:[A-Za-z0-9$_]++|\\u[0-9a-fA-F]{4})*+"

_DQ = r'"[^"\\\x03]*+(?:\\[^\x03][^"\\\x03]*+)*+'
_SQ = r"'[^'\\\x03]*+(?:\\[^\x03][^'\\\x03]*+)*+"
#: An unterminated string runs to the end of the text.
STRING = rf"(?:{_DQ}\"?|{_SQ}'?)"


def _by_first(words: list[str]) -> str:
    """Alternation grouped by first character, longest word first, so that most attempts fail on one test."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        groups.setdefault(w[0], []).append(_literal(w[1:]))
    return "|".join(_literal(c) + f"(?:{'|'.join(rest)})" for c, rest in groups.items())


_OPS = _by_first(OPERATORS + DELIMITERS)
#: Keywords and punctuation after which a slash starts a regex literal.
REGEX_HEAD = f"(?:{_by_first(KEYWORDS + OPERATORS + [d for d in DELIMITERS if d not in NO_REGEX_AFTER])})"
#: Identifiers that share no first letter with a keyword need no regex-literal test.
PLAIN_WORD = "[A-Zghjkmopquxz$_](?:[A-Za-z0-9$_]++|\\\\u[0-9a-fA-F]{4})*+"

#: Template characters up to a substitution or the closing backtick.
TEMPLATE_CHARS = r"(?:[^`\\$\x03]++|\\[^\x03]|\$++(?:[^{`\\$\x03]|\\[^\x03]))*+"

_LEXEMES = (
    rf"{TRIVIA}(?:{PLAIN_WORD}|{REGEX_HEAD}{TRIVIA}{REGEX}|`{TEMPLATE_CHARS}\$*+`|{NUMBER}|{STRING}|{IDENTIFIER}|{_OPS}|[\s\S])"
)
#: Leading trivia plus one token. A regex literal is recognised by what precedes it: it is matched together with the keyword or operator
#: before it (``SPLIT_HEAD`` takes the two apart) or at the start of the text. Templates with substitutions are cut out beforehand.
LEXEME = rf"\A{TRIVIA}{REGEX}|{_LEXEMES}"
_TRAILING = rf"|(?:[ \t\r\n]++|{COMMENT})++"
#: The same for code that ends at a template segment, where trailing trivia has no token to lead ...
BODY_LEXEME = LEXEME + _TRAILING
#: ... and for code after a finished template, where a slash is a division.
AFTER_LEXEME = _LEXEMES + _TRAILING

SPLIT_HEAD = rf"\A({TRIVIA}{REGEX_HEAD})({TRIVIA}{REGEX})\z"
ONLY_TRIVIA = rf"\A{TRIVIA}\z"
LEADING_TRIVIA = rf"\A{TRIVIA}"
