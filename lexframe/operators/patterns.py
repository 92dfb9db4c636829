"""Destructuring: binding patterns as a tree over matched brackets, the names they bind and the paths these are taken from.

A bracket is a *root* where its surroundings make it a pattern (declaration, parameter, ``catch``, loop head, left side of an assignment), a *target* where
it is a pattern if the bracket around it is one (element of an array, value of a key, rest) and anything else otherwise. So a target belongs to the
nearest bracket around it that is no target, and is a pattern if that one is a root: one window over the brackets that are no targets
hands the context down any number of levels, no level by level rounds. Paths are those of the brackets open around, kept on a stack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexframe.functions.vectors import V, at, case, either, names_of, true
from lexframe.operators.passes import Found, Tokens, rows_of, scan
from lexframe.operators.structure import CAN_END, NAMES

KEPT = ["(", ")", "[", "]", "{", "}", "TEMPLATE_HEAD", "TEMPLATE_TAIL", ",", "=", ":", "...", "THIS", *NAMES]
#: What is counted directly in a pattern.
COUNTS = ["names", "defaults", "holes", "shorthands", "computed_keys"]


class Targets:
    """Brackets, names, rests and holes of patterns by root and position: lists of one value for each."""

    def __init__(self, t: Tokens):
        kept = rows_of(t.kind.isin(*KEPT))
        rows = t.subset(kept)

        def sub(column: V) -> V:
            return V(column.v[kept], None if column.ok is None else column.ok[kept])

        kind, p1, p2, n1 = sub(t.kind), sub(t.p(1)), sub(t.p(2)), sub(t.n_(1))
        after, pos = sub(t.after), sub(t.pos)
        is_open, is_close = sub(t.is_open), sub(t.is_close)
        here = rows.window(t.level[kept])
        commas = V(here.sum((kind == ",").v))
        last_open, mark = here.last(is_open), here.last(kind.isin(",", "=") | is_open)

        def around(column: V) -> V:
            """An opening bracket is on the level of its inside; the token before it is on that of the bracket around."""
            return case((is_open, rows.by_pos.lag(column)), other=column)

        own = around(last_open)
        index = around(commas) - at(own, commas)
        own_kind, own_head, own_role = at(own, kind), at(own, sub(t.head_standard)), at(own, sub(t.paren_role))
        own_after, own_before = at(own, after), at(own, p1)
        placed = ((own_kind == "[") & p1.isin("[", ",", "...")) | (
            (own_kind == "{") & (((p1 == ":") & (at(around(mark), kind) != "=")) | (p1 == "...")))
        header = (own_head == "function") | (own_role == "arrow") | ((own_after == "{") & own_head.null())
        loop = own_before.isin("FOR", "AWAIT") & (p1 == "(") & ((after == "IN") | ((after == "IDENTIFIER") & (sub(t.after_word) == "of")))
        begins = ~true(p1.isin(*CAN_END)) | sub(t.inserted) | true(sub(t.statement_position))
        in_paren = own_kind == "("
        parameter = true(in_paren & header & p1.isin("(", ",", "..."))
        bracket = kind.isin("[", "{")
        root = case((bracket, case(
            (sub(t.declared_by).there(), "declaration"), (true(in_paren & (own_before == "CATCH") & (p1 == "(")) & ~true(at(own, p2) == "."), "catch"),
            (parameter & (own_role == "arrow"), "arrow_parameter"), (parameter, "parameter"), (true(in_paren & loop), "loop"),
            (true(after == "=") & begins & ~true(placed), "assignment"),
        )))
        target, param = true(placed), true(in_paren & header)
        stop = is_open & ~(bracket & target & root.null())
        stopped = case((is_open | is_close, at(last_open, stop)))
        nest = rows.by_pos.sum(case((true(stopped) & is_open, 1), (true(stopped), -1), other=0).v)
        at_root = rows.window(nest).last(is_open & true(stopped))
        # an element that is assigned to, but in no pattern, is a pattern of its own
        alone = bracket & target & at(at_root, root).null() & true(after == "=")
        self_row = V(np.arange(rows.n, dtype=np.int32))
        at_root, position = case((alone, self_row), other=at_root), case((alone, "assignment"), other=at(at_root, root))
        bound = position.there()
        in_pattern = own_kind.isin("[", "{")
        shorthand = kind.isin(*NAMES) & (own_kind == "{") & p1.isin("{", ",") & n1.isin(",", "}", "=")
        plain = true(kind.isin(*NAMES, "THIS") & in_pattern & bound & (target | shorthand))
        member = n1.isin(".", "[", "(")
        is_pattern = bracket & bound & (root.there() | target | alone)
        in_rest = true((bound & in_pattern) | param)
        what = case(
            (is_pattern & (kind == "{"), "object"), (is_pattern, "array"), (plain & member, "member"), (plain, "name"),
            (true((kind == ",") & bound & (own_kind == "[") & p1.isin("[", ",")), "hole"), ((kind == "...") & in_rest, "rest"), (kind == "...", "spread"),
        )
        found = rows_of(what.there())
        # by root, and by position within
        root_pos = either(at(at_root, pos), pos).v
        found = found[np.lexsort([rows.at_pos[found], root_pos[found], rows.script[found]])]
        self.tokens, self.kept, self.n = t, kept[found], len(found)

        def out(column: V) -> list:
            return [None if not ok else x for x, ok in zip(column.v[found].tolist(), column.there().v[found].tolist(), strict=True)]

        def names(column: V) -> list:
            table = names_of()
            return [None if x is None else table[x] for x in out(column)]

        self.pos, self.root_pos, self.script = out(pos), root_pos[found].tolist(), rows.script[found].tolist()
        self.what, self.position, self.parent = names(what), names(position), out(at(own, pos))
        self.close, self.items = out(sub(at(t.partner, t.pos))), out(sub(t.items))
        self.has_default = out(case((bracket, after == "="), other=n1 == "="))
        self.shorthand, self.is_rest = out(true(shorthand)), out(p1 == "...")
        self.computed = out(true((p1 == ":") & (p2 == "]")))
        texts = Found(t, self.kept)
        self.text, before2 = texts.text(t.row).to_pylist(), texts.text(t.p(2, "row")).to_pylist()
        self.step = []
        is_root, names_ = out(true(at(at_root, pos) == pos)), out(kind.isin(*NAMES))
        for k, (rest, arrayed, colon, i) in enumerate(zip(self.is_rest, out(own_kind == "["), out(p1 == ":"), out(index), strict=True)):
            if is_root[k]:
                step = ""
            elif rest:
                step = "..."
            elif arrayed:
                step = f"[{i}]"
            elif colon:
                step = "[*]" if self.computed[k] else "" if before2[k] is None else "." + before2[k]
            else:
                step = "." + self.text[k] if names_[k] else ""
            self.step.append(step)

    def placed(self, rows: list[int]) -> tuple[list[str], list[int]]:
        """Path and nesting of these: the steps of the brackets of their root that are open around them."""
        paths, nesting = [], []
        group, open_, here = None, [], []
        for k in rows:
            pos = self.pos[k]
            if group != (self.script[k], self.root_pos[k]):
                group, open_, here = (self.script[k], self.root_pos[k]), [], []
            if here and here[0][0] < pos:
                open_ += here
                here = []
            while open_ and open_[-1][1] is not None and open_[-1][1] <= pos:
                open_.pop()
            paths.append("".join([x[2] for x in open_]) + self.step[k])
            nesting.append(len(open_))
            if self.what[k] in ("object", "array"):
                here.append((pos, self.close[k], self.step[k]))
        return paths, nesting

    def batch(self, schema: pa.Schema, rows: list[int], **columns: list) -> list[pa.RecordBatch]:
        if not rows:
            return []
        found = Found(self.tokens, self.kept[rows])
        return [found.batch(schema, **{n: pa.array(x, schema.field(n).type) for n, x in columns.items()})]

    def take(self, name: str, rows: list[int]) -> list:
        column = getattr(self, name)
        return [column[k] for k in rows]


def _bindings(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    x = Targets(t)
    rows = [k for k in range(x.n) if x.position[k] is not None and x.what[k] in ("object", "array", "name", "member")]
    paths, _ = x.placed(rows)
    wanted = [i for i, k in enumerate(rows) if x.what[k] in ("name", "member")]
    paths, rows = [paths[i] for i in wanted], [rows[i] for i in wanted]
    columns = {n: x.take(n, rows) for n in ("pos", "root_pos", "position", "has_default", "is_rest", "shorthand", "computed")}
    return x.batch(schema, rows, name=x.take("text", rows), path=paths, target=x.take("what", rows), **columns)


def _patterns(t: Tokens, schema: pa.Schema) -> list[pa.RecordBatch]:
    x = Targets(t)
    paths, nesting = x.placed(list(range(x.n)))
    counts: dict[tuple, list[int]] = {}
    for k in range(x.n):
        what = x.what[k]
        if what not in ("rest", "spread") and x.parent[k] is not None:
            n = counts.setdefault((x.script[k], x.root_pos[k], x.parent[k]), [0] * len(COUNTS))
            tests = (what == "name", what != "hole" and x.has_default[k], what == "hole", x.shorthand[k], what != "hole" and x.computed[k])
            for i, test in enumerate(tests):
                n[i] += bool(test)
    rows = [k for k in range(x.n) if x.what[k] in ("object", "array", "rest", "spread")]
    bracket = [x.what[k] in ("object", "array") for k in rows]
    found = [counts.get((x.script[k], x.root_pos[k], x.pos[k]), [0] * len(COUNTS)) if b else [0] * len(COUNTS) for k, b in zip(rows, bracket, strict=True)]

    def of_brackets(values: list) -> list:
        return [v if b else None for v, b in zip(values, bracket, strict=True)]

    def either_(a: list, b: list) -> list:
        return [x if c else y for x, y, c in zip(a, b, bracket, strict=True)]

    return x.batch(
        schema, rows, pos=x.take("pos", rows), shape=either_(x.take("what", rows), ["element"] * len(rows)),
        position=either_(x.take("position", rows), x.take("what", rows)), item_count=of_brackets(x.take("items", rows)),
        nesting=of_brackets([nesting[k] for k in rows]), path=of_brackets([paths[k] for k in rows]), has_default=of_brackets(x.take("has_default", rows)),
        **{n: [f[i] for f in found] for i, n in enumerate(COUNTS)},
    )


def pattern_bindings(tokens: DataFrame) -> DataFrame:
    """Names that patterns bind (members that they assign to), with the path of the value they take."""
    return scan(tokens, _bindings, "pos int, name string, root_pos int, position string, path string, target string, has_default boolean, is_rest boolean, "
                "shorthand boolean, computed boolean")


def patterns(tokens: DataFrame) -> DataFrame:
    """Patterns, nested ones with their path, and what is directly in them; rest and spread elements are rows as well."""
    return scan(tokens, _patterns, "pos int, shape string, position string, item_count int, nesting int, path string, has_default boolean, "
                + ", ".join(f"{n} int" for n in COUNTS))
