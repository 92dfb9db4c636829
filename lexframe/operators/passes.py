"""The structure of scripts in one pass: bracket partners, conditionals, brace kinds, inserted semicolons and what operators find with them.

The stages are those of ``structure``, ``rules`` and ``nodes``, over arrays of whole scripts instead of a window and a sort of token rows each. Token
rows are sorted once, by script and position; a task holds the rows of some scripts (at least ``BATCH`` tokens, or one script) as numbers. A stage
is worked out when an operator asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.functions import adjacency as A
from lexframe.functions.vectors import Rows, V, Window, at, case, code, either, names_of, true
from lexframe.operators.structure import (
    BLOCK_AFTER, CAN_END, CLOSERS, CONTINUES, CONTROL, NAMES, OPENERS, RESTRICTED, STATEMENT_START_AFTER, SUPPRESS,
)
from lexframe.operators.tokens import by_pos
from lexframe.sources.shipping import ship

#: Tokens worked on at once: some arrays of them fit into a processor's cache.
BATCH = 1 << 16
#: Texts that a test compares with.
WORDS = ["of", "from", "as", "get", "set", "static", "constructor", "`", "async", "*", ","]
OPERAND_END = [c for c in CAN_END if c not in ("DEFAULT", "++", "--")]
_OTHER = "other text"


def _numbers(names: pa.Array, table: dict[str, int] | None = None) -> V:
    """Names as numbers; with ``table`` only its names, all others are alike."""
    coded = names.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.unify_dictionaries().combine_chunks()
    of = np.array([code(x) if table is None else table.get(x, table[_OTHER]) for x in coded.dictionary.to_pylist()] or [0], np.int16)
    return _column(of[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)], coded)


def _column(v: np.ndarray, like) -> V:
    return V(v, like.is_valid().to_numpy(zero_copy_only=False) if like.null_count else None)


class Tokens(Rows):
    """The tokens of some scripts."""

    def __init__(self, table: pa.Table):
        self.ids, self.text, self.raw = table["script_id"], table["text"], table["raw"] if "raw" in table.column_names else None
        first = table["_first"].to_numpy()
        super().__init__(np.cumsum(first, dtype=np.int32), table["pos"].fill_null(-1).to_numpy().astype(np.int32))
        self.pos = _column(self.at_pos, table["pos"])
        self.kind = _numbers(table["kind"].combine_chunks())
        words = pa.array(WORDS)
        found = pc.index_in(self.text, words).fill_null(len(WORDS)).to_numpy()
        self.word = _column(np.array([code(w) for w in [*WORDS, _OTHER]], np.int16)[found], self.text)
        newline = table["newline_before"].fill_null(False).to_numpy()
        self.newline = _column(newline, table["newline_before"])
        self.row = V(np.arange(self.n, dtype=np.int32))
        self.nothing = V(self.row.v, np.zeros(self.n, bool))
        self._near: dict[tuple[str, int], V] = {}

    # --- neighbours ----------------------------------------------------------------------------------

    def p(self, k: int, what: str = "kind") -> V:
        """Kind (or another column) of the ``k``-th token before."""
        if (what, -k) not in self._near:
            self._near[what, -k] = self.by_pos.lag(getattr(self, what), k)
        return self._near[what, -k]

    def n_(self, k: int, what: str = "kind") -> V:
        if (what, k) not in self._near:
            self._near[what, k] = self.by_pos.lead(getattr(self, what), k)
        return self._near[what, k]

    @cached_property
    def is_open(self) -> V:
        return self.kind.isin(*OPENERS)

    @cached_property
    def is_close(self) -> V:
        return self.kind.isin(*CLOSERS)

    def _steps(self, up: V, down: V) -> np.ndarray:
        return self.by_pos.sum(up.v.astype(np.int8) - down.v.astype(np.int8)).astype(np.int32)

    @cached_property
    def depth(self) -> np.ndarray:
        return self._steps(self.is_open, self.is_close)

    @cached_property
    def brace_depth(self) -> np.ndarray:
        return self._steps(self.kind == "{", self.kind == "}")

    @cached_property
    def level(self) -> np.ndarray:
        """A bracket and what is directly inside it share one."""
        return self.depth + self.is_close.v

    @cached_property
    def outside(self) -> np.ndarray:
        """Level with an opening bracket on that of the bracket around it, a closing one on that of its inside."""
        return self.depth - self.is_open.v + self.is_close.v

    @cached_property
    def inside(self) -> Window:
        return self.window(self.level)

    # --- brackets ------------------------------------------------------------------------------------

    @cached_property
    def _pairs(self) -> tuple[V, ...]:
        """For brackets on their level: rows of the one, two and three before and of the next; null elsewhere."""
        at_ = np.flatnonzero(self.is_open.v | self.is_close.v).astype(np.int32)
        rows = self.subset(at_)
        w = rows.window(self.level[at_])

        def whole(found: V) -> V:
            v, ok = np.zeros(self.n, np.int32), np.zeros(self.n, bool)
            v[at_], ok[at_] = at_[found.v] if len(at_) else 0, found.ok
            return V(v, ok)

        return tuple(whole(x) for x in (w.before(1), w.before(2), w.before(3), w.behind(1)))

    @cached_property
    def _opened(self) -> V:
        return true(self.is_open & at(self._pairs[3], self.kind).isin(*CLOSERS))

    @cached_property
    def _closed(self) -> V:
        return true(self.is_close & at(self._pairs[0], self.kind).isin(*OPENERS))

    @cached_property
    def partner(self) -> V:
        return case((self._opened, self._pairs[3]), (self._closed, self._pairs[0]))

    @cached_property
    def own(self) -> V:
        """The opening bracket of a bracket's pair."""
        return case((self.is_open, self.row), (self._closed, self._pairs[0]))

    @cached_property
    def end(self) -> V:
        return case((self.is_close, self.row), (self._opened, self._pairs[3]))

    @cached_property
    def _body(self) -> V:
        """For braces behind parentheses: the opening one of these."""
        prev, prev2, prev3, _ = self._pairs
        pos = self.pos
        opens = self.is_open & (self.kind == "{") & (at(prev, self.kind) == ")") & (at(prev, pos) == pos - 1)
        closes = self._closed & (self.kind == "}") & (at(prev2, self.kind) == ")") & (at(prev2, pos) == at(prev, pos) - 1)

        def opener(row: V) -> V:
            return case((true(at(row, self.is_open)), row))

        return case((opens, opener(prev2)), (closes, opener(prev3)))

    @cached_property
    def _heads(self) -> tuple[V, V]:
        """What an opening parenthesis heads, as the reference and as the standard has it."""
        p1, p2, p3 = self.p(1), self.p(2), self.p(3)
        control = p1.isin(*CONTROL) & ~true(p2 == ".")
        function = (p1 == "FUNCTION") | ((p2 == "FUNCTION") & p1.isin(*NAMES))
        generator = ((p1 == "*") & (p2 == "FUNCTION")) | (p1.isin(*NAMES) & (p2 == "*") & (p3 == "FUNCTION"))
        paren = self.kind == "("

        def head(function: V, control: V) -> V:
            return case((paren & true(function), "function"), (paren & true(control), "control"))

        return head(function, control), head(function | generator, control | ((p1 == "AWAIT") & (p2 == "FOR")))

    @cached_property
    def head(self) -> V:
        return at(self.own, self._heads[0])

    @cached_property
    def head_standard(self) -> V:
        return at(self.own, self._heads[1])

    @cached_property
    def body_of(self) -> V:
        return at(self._body, self._heads[0])

    @cached_property
    def body_of_standard(self) -> V:
        return at(self._body, self._heads[1])

    @cached_property
    def body_p1(self) -> V:
        return at(self._body, self.p(1))

    @cached_property
    def after(self) -> V:
        return at(self.end, self.n_(1))

    @cached_property
    def after_word(self) -> V:
        return at(self.end, self.n_(1, "word"))

    @cached_property
    def open_p1(self) -> V:
        return at(self.own, self.p(1))

    @cached_property
    def open_p2(self) -> V:
        return at(self.own, self.p(2))

    @cached_property
    def open_newline(self) -> V:
        return at(self.own, self.newline)

    @cached_property
    def _span(self) -> V:
        there = at(self.partner, self.pos)
        return case((self._opened, there - self.pos), (self._closed, self.pos - there))

    @cached_property
    def empty(self) -> V:
        return self._span == 1

    @cached_property
    def items(self) -> V:
        commas = V(self.inside.sum((self.kind == ",").v))
        between = self._within(commas)
        trailing = at(self.end, true(self.p(1) == ","))
        return case((self.empty, 0), other=between + 1 - V(trailing.v.astype(np.int32)))

    def _within(self, counted: V) -> V:
        """Count inside of a pair, from running counts of the level."""
        there = at(self.partner, counted)
        return case((self._opened, there - counted), (self._closed, counted - there))

    def marks(self, name: str) -> V:
        """What ``structure.clause_marks`` counts, directly inside a pair or, at the end, in the outermost level."""
        kind, p1, n1 = self.kind, self.p(1), self.n_(1)
        if name == "semis":
            step = (kind == ";").v.astype(np.int32)
        elif name == "loops":
            step = ((kind == "IN") | ((kind == "IDENTIFIER") & (self.word == "of"))).v.astype(np.int32)
        elif name == "gaps":
            step = ((kind == ",") & p1.isin(",", "(", "{")).v.astype(np.int32)
        else:
            do = (kind == "DO") & ~true(p1 == ".") & ~true(n1.isin(":", "("))
            step = case((do, 1), (kind == "WHILE", -1), other=0).v
        counted = V(self.inside.sum(step))
        return case((self._opened | self._closed, self._within(counted)), (kind == "EOF", counted))

    @cached_property
    def paren_role(self) -> V:
        paren = self.kind.isin("(", ")")
        return case((paren & (self.after == "=>"), "arrow"), (paren, either(self.head, "other")))

    @cached_property
    def encl(self) -> V:
        """For names, ``default`` and ``...``: the bracket directly around."""
        return case((self.kind.isin(*NAMES, "DEFAULT", "..."), self.inside.last(self.is_open, own=False)))

    # --- conditionals --------------------------------------------------------------------------------

    @cached_property
    def in_braces(self) -> Window:
        return self.window(self.brace_depth)

    @cached_property
    def brace(self) -> V:
        """For ``( ? :``: the brace around."""
        return case((self.kind.isin("(", "?", ":"), self.in_braces.last(self.kind == "{")))

    @cached_property
    def _pending(self) -> V:
        """Open conditionals before a token, among the tokens of its braces."""
        here, kind = self.in_braces, self.kind
        # entering braces resets the count by a step that no count reaches
        step = case((kind == "?", 1), (kind == ":", -1), (kind == "{", -2 * self.n - 2), other=0).v.astype(np.int64)
        total = here.sum(step)
        low = np.minimum(here.min(V(total)).v, 0)
        return either(here.lag(V(total - low)), 0)

    @cached_property
    def conditional(self) -> V:
        return case((self.kind == ":", self._pending > 0), (self.kind == "?", True))

    @cached_property
    def ternary_open(self) -> V:
        return case((self.kind.isin(";", "EOF"), self._pending > 0))

    @cached_property
    def _after_conditional(self) -> V:
        here = self.in_braces
        return case((self.kind == "}", here.lag(self.conditional) & (here.lag(self.kind) == ":")))

    # --- braces --------------------------------------------------------------------------------------

    @cached_property
    def brace_kind(self) -> V:
        kind = self.kind
        is_brace, p1 = kind.isin("{", "}"), self.open_p1
        cond = case((kind == "{", true(self.p(1, "conditional"))), other=true(self._after_conditional))
        ended = self.open_newline & (p1.isin(*CAN_END) | p1.isin(*RESTRICTED))
        own = case(
            (self.body_of == "function", "function"), (p1.null() | p1.isin(*BLOCK_AFTER), "block"),
            (p1 == ":", case((cond, "object"))), (ended, "block"), other="object",
        )
        own = case((is_brace, own))
        settled = is_brace & own.there()
        opens = settled & (kind == "{")
        nest = self._steps(opens, settled & (kind == "}"))
        outer = at(self.window(nest).last(opens), own)
        unsettled = case((V(nest > 0) & (outer == "object"), "object"), other="block")
        return case((is_brace, either(own, unsettled)))

    # --- inserted semicolons -------------------------------------------------------------------------

    def _closes(self, head: V, body: V, what: str) -> V:
        return true(((self.kind == ")") & (head == what)) | ((self.kind == "}") & (body == what)))

    @cached_property
    def closed_control(self) -> V:
        return true((self.kind == ")") & (self.head == "control"))

    @cached_property
    def _statement(self) -> tuple[V, V]:
        p1, p2 = self.p(1), self.p(2)
        here = p1.isin(*STATEMENT_START_AFTER) | true(self.p(1, "closed_control"))
        there = p2.isin(*STATEMENT_START_AFTER) | true(self.p(2, "closed_control"))
        return case((p1.null(), True), other=here), case((p2.null(), True), other=there)

    @property
    def statement_position(self) -> V:
        return self._statement[0]

    @cached_property
    def function_form(self) -> V:
        statement, behind_async = self._statement
        function = self.kind == "FUNCTION"
        declared = function & (statement | ((self.p(1) == "ASYNC") & behind_async))
        return case((true(declared), "declaration"), (function, "expression"))

    @cached_property
    def _after_do_while(self) -> V:
        do_close = true((self.kind == "}") & (self.open_p1 == "DO"))
        while_of_do = (self.kind == "WHILE") & true(self.by_pos.lag(do_close))
        latest = at(self.by_pos.last(true(while_of_do)), self.pos)
        partner_pos = at(self.partner, self.pos)
        return true((self.p(1) == ")") & (latest == self.by_pos.lag(partner_pos) - 1))

    def asi(self, mode: str = "standard") -> V:
        """The rule that puts a semicolon before a token."""
        if ("asi", mode == "standard") not in self._near:
            self._near["asi", mode == "standard"] = self._asi(mode == "standard")
        return self._near["asi", mode == "standard"]

    def _asi(self, standard: bool) -> V:
        kind, p1, newline = self.kind, self.p(1), self.newline
        arrow_head = true((kind == "(") & (self.paren_role == "arrow"))
        plain_paren = true((kind == "(") & ~arrow_head)
        function_paren = plain_paren & true(self.n_(1) == "FUNCTION")
        is_end = kind == "EOF"
        in_object = true(self.brace_kind == "object")
        heads = self.head_standard if standard else self.head
        closed_function = self._closes(heads, self.body_of_standard if standard else self.body_of, "function")
        control = true(self.by_pos.lag(true((kind == ")") & (heads == "control"))))
        function = true(self.by_pos.lag(closed_function))
        suppressed = kind.isin(*(CONTINUES if standard else SUPPRESS)) | (plain_paren & ~function_paren)
        return case(
            (p1.null() | p1.isin(";", "{"), None),
            *([(self._after_do_while & (kind != ";"), "do_while")] if standard else []),
            (control, None),
            (function & (self.function_form == "declaration"), "after_function"),
            (function & (kind.isin("{", "[", ".") | plain_paren), None),
            ((p1 == ")") & (kind == "=>"), None),
            (p1.isin(*RESTRICTED), case((newline | is_end | (kind == "}"), "restricted"))),
            (kind.isin("CATCH", "FINALLY"), None),
            ((p1 == "}") & kind.isin("ELSE", "WHILE"), None),
            (~p1.isin(*CAN_END), None),
            (is_end, "end_of_file"),
            (kind == "}", case((~in_object, "close_brace"))),
            (newline & function_paren, "function_paren"),
            (newline & ~suppressed & (kind != ";"), "newline"),
        )

    @cached_property
    def inserted(self) -> V:
        return self.asi().there()

    # --- methods, clauses, declarators ---------------------------------------------------------------

    def in_members(self) -> V:
        """As ``rules.in_members``."""
        level = V(self.level)
        return true((self.after == "{") & (level == at(self.brace, level) + 1) & ~at(self.brace, self.open_p1).isin(*BLOCK_AFTER))

    @cached_property
    def method(self) -> dict[str, V]:
        """As ``rules.with_methods``; ``there`` tells the parentheses of method headers."""
        key_words = [*NAMES, "STRING", "NUMBER", "]", *[w for w in A.WORDS if w != "FUNCTION"]]
        p1 = self.p(1)
        computed = p1 == "]"
        # the bracket of a computed key, if it is one
        key = self.by_pos.lag(case((true(at(self.own, self.kind) == "["), self.own)))

        def before(k: int, what: str) -> V:
            return case((computed, at(key, self.p(k, what))), other=self.p(k + 1, what))

        b = {k: before(k, "kind") for k in (1, 2, 3)}
        t = {k: before(k, "word") for k in (1, 2, 3, 4)}
        star = true(b[1] == "*")
        c1, c2 = case((star, b[2]), other=b[1]), case((star, b[3]), other=b[2])
        c1t, c2t, c3t = case((star, t[2]), other=t[1]), case((star, t[3]), other=t[2]), case((star, t[4]), other=t[3])
        is_async = true(c1 == "ASYNC")
        named1 = true(case((is_async, c2), other=c1) == "IDENTIFIER")
        word1 = case((is_async, c2t), other=c1t)
        named2 = ~is_async & true(c2 == "IDENTIFIER")
        word2 = case((is_async, c3t), other=c2t)
        accessor = case((named1 & word1.isin("get", "set"), word1))
        is_static = (named1 & (word1 == "static")) | (named1 & named2 & (word2 == "static"))
        is_class = true(at(self.brace, self.open_p1).isin(*[x for x in CAN_END if x != "DEFAULT"], "CLASS"))
        prefix_ok = ~named1 | case((named2, (word2 == "static") & word1.isin("get", "set")), other=word1.isin("static", "get", "set"))
        name = case((~true(computed), self.p(1, "word")))
        constructor = is_class & ~is_static & true(name == "constructor")
        plain = self.head.null() & self.head_standard.null()
        level = V(self.level)
        is_method = (
            (self.kind == "(") & (self.after == "{") & (plain | (p1.isin(*CONTROL) & self.in_members())) & p1.isin(*key_words)
            & (level == at(self.brace, level) + 1) & ~true(b[1].isin(".", "NEW"))
        )
        return {
            "there": true(is_method), "owner": case((is_class, "class"), other="object"), "word": name, "name": case((~true(computed), self.p(1, "row"))),
            "computed": computed, "is_static": is_static, "generator": star, "is_async": is_async, "prefix_ok": prefix_ok,
            "method_kind": case((accessor.there(), accessor), (constructor, "constructor"), other="method"),
        }

    @cached_property
    def in_clause(self) -> V:
        """Within the clause of an import or export, up to its source or end."""
        kind = self.kind
        opens = kind.isin("IMPORT", "EXPORT") & ~true(self.p(1) == ".") & self.n_(1).isin(*NAMES, "{", "*")
        ends = kind.isin("STRING", ";") | kind.isin("IMPORT", "EXPORT", "VAR", "LET", "CONST", "FUNCTION", "CLASS", "=")
        return true(at(self.by_pos.last(true(opens | ends), own=False), true(opens)))

    @cached_property
    def clause_kind(self) -> V:
        return at(self.by_pos.last(self.kind.isin("IMPORT", "EXPORT"), own=False), self.kind)

    @cached_property
    def source_row(self) -> V:
        """The string that is the source of a clause: the next one of the statement."""
        source = true((self.kind == "STRING") & (true(self.p(1, "word") == "from") | true(self.p(1) == "IMPORT")))
        found = self.by_pos.next(source | self.kind.isin(";", "IMPORT", "EXPORT"))
        return case((true(at(found, source)), found))

    @cached_property
    def property(self) -> V:
        """As ``nodes._property``."""
        kind, p1, p2, n1 = self.kind, self.p(1), self.p(2), self.n_(1)
        modifier = (p1 == "ASYNC") | ((p1 == "IDENTIFIER") & self.p(1, "word").isin("get", "set", "static") & ~kind.isin("IN", "INSTANCEOF"))
        star = (p1 == "*") & (p2.isin("{", "}", ";", ",", "ASYNC") | (self.p(2, "word") == "static"))
        method = kind.isin(*[w for w in A.WORDS if w != "FUNCTION"]) & (n1 == "(") & (modifier | star) & ~self.newline
        return true(p1 == ".") | true((n1 == ":") & p1.isin("{", ",")) | true(method)

    def keyword(self, *names: str) -> V:
        return self.kind.isin(*names) & ~self.property

    @cached_property
    def _declarators(self) -> tuple[V, V]:
        word = self.kind.isin(*A.DECLARE) & ~self.property
        ends = self.kind.isin(";", "IN") | ((self.kind == "IDENTIFIER") & (self.word == "of")) | self.is_open | self.inserted
        mark = self.inside.last(true(word | ends))
        mark = case((true(at(mark, word)), mark))
        separates = (self.kind == ",") & mark.there()
        return case((word | separates, mark)), separates

    @cached_property
    def declared_by(self) -> V:
        """The word whose declarator the token starts."""
        return case((self.kind.isin(*NAMES, "{", "["), self.by_pos.lag(self._declarators[0])))

    @cached_property
    def expression_end(self) -> V:
        """For an arrow with an expression body the row of the first token behind that expression.

        On the arrow's own nesting level that is a comma, a semicolon (inserted ones included), the bracket around it, the next part of a template, or the
        colon of a conditional that was open before the arrow.
        """
        kind = self.kind
        colon = true((kind == ":") & self.conditional)
        stops = kind.isin(",", ";", "TEMPLATE_MIDDLE", "EOF") | self.is_close | self.inserted | ((kind == ":") & ~colon)
        here = self.window(self.outside)
        stop = here.next(true(stops))
        open_ = here.sum_behind(colon.v.astype(np.int8) - (kind == "?").v) + colon.v
        closing = self.window(self.outside, open_).next(colon)
        nearer = case((stop.there() & closing.there(), V(np.minimum(stop.v, closing.v))), (stop.there(), stop), other=closing)
        return case((true((kind == "=>") & (self.n_(1) != "{")), nearer))

    # --- pairs ---------------------------------------------------------------------------------------

    @cached_property
    def right_class(self) -> V:
        """Class of a token as the right one of a pair."""
        kind, p1, n1 = self.kind, self.p(1), self.n_(1)
        named = (n1 == "(") & self.p(1, "word").isin(*A.METHOD_LEAD) & ~kind.isin("FUNCTION", "AWAIT", "YIELD")
        key = kind.isin(*A.WORDS) & (((n1 == ":") & p1.isin("{", ",")) | true(named))
        contextual = [((kind == "IDENTIFIER") & (self.word == w), w.upper()) for w in A.CONTEXTUAL]
        return case(
            ((p1 == ".") & kind.isin(*A.WORDS, "IDENTIFIER"), "PROPERTY"), (key, "NAME"), *contextual, (kind.isin(*NAMES), "NAME"),
            (kind.isin("NUMBER", "REGEX", "TRUE", "FALSE", "NULL"), "LITERAL"), (kind.isin("THIS", "SUPER"), "SELF"),
            (kind.isin("TEMPLATE_NO_SUB", "TEMPLATE_HEAD"), "TEMPLATE"), (kind.isin("TEMPLATE_MIDDLE", "TEMPLATE_TAIL"), "TEMPLATE_END"),
            (kind.isin(*A.DECLARE), "DECLARE"), (kind.isin(*A.PREFIX), "PREFIX"), (kind.isin("+", "-"), "SIGN"), (kind.isin("++", "--"), "UPDATE"),
            (kind.isin(*A.ASSIGN), "ASSIGN"), (kind.isin(*A.INFIX), "INFIX"), other=kind,
        )

    @cached_property
    def own_left(self) -> V:
        """Class of a token as the left one of a pair: what it ends."""
        kind, p1, right = self.kind, self.p(1), self.right_class
        class_body = self.open_p1.isin(*[x for x in CAN_END if x != "DEFAULT"], "CLASS")
        close = kind == ")"
        return case(
            (close & (self.paren_role == "arrow"), "ARROW_HEAD"), (close & (self.head_standard == "control"), "CONTROL_HEAD"),
            (close & (self.head_standard == "function"), "FUNCTION_HEAD"), (close, "CALL"),
            ((kind == "}") & (self.brace_kind == "object") & ~true(class_body), "OBJECT"), (kind == "}", "BLOCK"),
            (kind.isin("++", "--") & p1.isin(*OPERAND_END) & ~self.newline, "POSTFIX"), (kind.isin("++", "--"), "UPDATE"),
            ((right == "NAME") & p1.isin("CLASS", "EXTENDS"), "CLASS_NAME"), (kind.isin("TEMPLATE_NO_SUB", "TEMPLATE_TAIL"), "TEMPLATE_END"),
            (kind == "TEMPLATE_MIDDLE", "TEMPLATE"), other=right,
        )

    def left_class(self, mode: str) -> V:
        return case((self.asi(mode).there(), ";"), other=either(self.by_pos.lag(self.own_left), "BOS"))

    def illegal(self, mode: str) -> V:
        """The token cannot follow the one before it."""
        legal = _legal()[self.left_class(mode).v, self.right_class.v]
        return V(~legal) & (self.kind != "ERROR") & ~true(self.p(1) == "ERROR")

    # --- places --------------------------------------------------------------------------------------

    @cached_property
    def places(self) -> tuple[V, V]:
        """Line and column, as ``tokens.token_positions``."""
        size = pc.utf8_length(self.raw).fill_null(0).to_numpy()
        own_size = pc.utf8_length(self.text).fill_null(0).to_numpy()
        newlines = pc.count_substring(self.raw, "\n").fill_null(0).to_numpy()
        own = pc.count_substring(self.text, "\n").fill_null(0).to_numpy()
        lead = size - own_size
        after, lead_after = np.full(self.n, -1), np.full(self.n, -1)
        some = np.flatnonzero(newlines)
        for i, raw, k in zip(some.tolist(), self.raw.take(pa.array(some)).to_pylist(), lead[some].tolist(), strict=True):
            after[i] = len(raw) - 1 - raw.rfind("\n")
            lead_after[i] = k - 1 - raw.rfind("\n", 0, k) if "\n" in raw[:k] else -1
        end, lines = self.by_pos.sum(size), self.by_pos.sum(newlines)
        last_newline = either(self.by_pos.max(V(np.where(newlines > 0, end - after, 0), newlines > 0), own=False), 0)
        col = np.where(lead_after >= 0, lead_after + 1, end - size + lead - last_newline.v + 1)
        there = None if self.raw.null_count == 0 else self.raw.is_valid().to_numpy()
        return V((lines - own + 1).astype(np.int32), there), V(col.astype(np.int32), there)


@lru_cache(maxsize=None)
def _legal() -> np.ndarray:
    pairs = A.legal_pairs()
    table = np.zeros((1 << 10, 1 << 10), bool)
    table[[code(a) for a, _ in pairs], [code(b) for _, b in pairs]] = True
    return table


# --- running an operator over a token table -------------------------------------------------------------


Find = Callable[["Tokens", pa.Schema], list[pa.RecordBatch]]


class Found:
    """Rows of a result: token rows with columns by name."""

    def __init__(self, tokens: Tokens, rows: np.ndarray):
        self.tokens, self.rows = tokens, rows

    def of(self, x) -> pa.Array:
        """The values of a column of the tokens in these rows."""
        if isinstance(x, pa.Array):
            return x
        if isinstance(x, str):
            return pa.array([x] * len(self.rows), pa.string())
        if isinstance(x, np.ndarray):
            return pa.array(x[self.rows])
        ok = None if x.ok is None else ~x.ok[self.rows]
        v = x.v[self.rows]
        if v.dtype == np.int16:
            return pa.DictionaryArray.from_arrays(pa.array(v, mask=ok), pa.array(names_of())).cast(pa.string())
        return pa.array(v, mask=ok)

    def text(self, row: V) -> pa.Array:
        """Texts of the tokens whose numbers are in ``row``."""
        return _flat(self.tokens.text.take(self.of(row)))

    def batch(self, schema: pa.Schema, **columns) -> pa.RecordBatch:
        arrays = [_flat(self.tokens.ids.take(pa.array(self.rows))) if n == "script_id" else self.of(columns[n]) for n in schema.names]
        return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


def _flat(a) -> pa.Array:
    return a if isinstance(a, pa.Array) else a.combine_chunks() if a.num_chunks != 1 else a.chunk(0)


def rows_of(test: V) -> np.ndarray:
    return np.flatnonzero(test.v)


def _whole_scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole scripts with ``BATCH`` rows or more, but for the last."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= BATCH and (starts := np.flatnonzero(b["_first"].to_numpy(zero_copy_only=False))).size:
            cut = int(starts[-1])
            if n - b.num_rows + cut:
                yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held, n = [b.slice(cut)], b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def scan(tokens: DataFrame, find: Find, schema: str, *, places: bool = False) -> DataFrame:
    """What ``find`` makes of the tokens of every script: ``script_id`` and the columns of ``schema``. Tokens that have their scripts together need no exchange."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = tokens.sparkSession
    ship(spark)
    columns = ["script_id", "pos", "kind", "text", "newline_before", *(["raw"] if places else [])]
    made = StructType([tokens.schema["script_id"], *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(made)
        for table in _whole_scripts(batches):
            yield from find(Tokens(table), arrow)

    ordered = tokens.select(*columns, (F.row_number().over(by_pos()) == 1).alias("_first"))
    return ordered.mapInArrow(run, made)
