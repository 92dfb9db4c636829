"""Cuts scripts with template substitutions at their template segments, to any depth.

What a backtick or a closing brace means depends on what is open around it, which no regular expression can tell. So one linear pass
notes where segments lie; the code between them is tokenized by Spark expressions like any other. Only texts with a substitution come here.
"""

from __future__ import annotations

import re

from lexframe.functions import patterns as P

_NO_SUB = rf"`{P.TEMPLATE_CHARS}\$*+`"
_TOKEN = re.compile(
    rf"{P.TRIVIA}(?:{P.PLAIN_WORD}|(?P<head>{P.REGEX_HEAD}){P.TRIVIA}{P.REGEX}|{_NO_SUB}|(?P<mark>[`{{}}\x03])"
    rf"|{P.NUMBER}|{P.STRING}|{P.IDENTIFIER}|[\s\S])"
)
_REGEX_FIRST = re.compile(rf"{P.TRIVIA}{P.REGEX}")
_SEGMENT = re.compile(rf"{P.TEMPLATE_CHARS}(?:\$++\{{|\$*+`)")

PIECES = "array<struct<code: string, segment: string, after: boolean>>"


def pieces(src: str) -> list[tuple[str, str, bool]]:
    """(code, the segment that ends it, whether a finished template precedes the code); the last segment is empty.

    A template that is not closed is no template: its backtick stays in the code.
    """
    out: list[tuple[str, str, bool]] = []
    opened: list[tuple] = []  # how to go on if the template turns out not to be closed
    braces: list[int] = []
    unclosed: set[int] = set()
    at = start = 0
    after, fresh = False, True

    def segment(mark: int):
        return _SEGMENT.match(src, mark + 1)

    while True:
        found = fresh and _REGEX_FIRST.match(src, at)
        fresh = False
        if found:
            at = found.end()
            continue
        found = _TOKEN.match(src, at)
        if found is None:
            mark, kind = len(src), "\x03"
        else:
            at, kind = found.end(), found["mark"]
            mark = at - 1
            if found["head"] == "{":
                kind = "{"
        if kind is None:
            continue
        if kind == "`":
            text = None if mark in unclosed else segment(mark)
            if text is None:
                unclosed.add(mark)
                continue
            opened.append((mark, len(out), start, after))
            braces.append(0)
        elif kind == "{":
            if braces:
                braces[-1] += 1
            continue
        elif kind == "}":
            if not braces or braces[-1]:
                if braces:
                    braces[-1] -= 1
                continue
            text = segment(mark)
        else:
            text = None
        if text is None:  # the end, or a segment that runs to it
            if not opened:
                out.append((src[start:], "", after))
                return out
            unclosed |= {o[0] for o in opened}
            mark, kept, start, after = opened[0]
            del out[kept:]
            at, opened, braces = mark + 1, [], []
            continue
        out.append((src[start:mark], src[mark: text.end()], after))
        at = start = text.end()
        after = text[0].endswith("`")
        fresh = not after
        if after:
            opened.pop()
            braces.pop()
