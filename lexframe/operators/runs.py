"""Mergeable summaries of parser traces.

A run is a stretch of consecutive events. Its summary says what the stretch adds to the report of a trace whatever came before it, so
neighbouring summaries merge into that of both, in any grouping, and no event is looked at again:

* Splits count for the token or rule that is current. Those before the first token of the run (or the first reduction on their parent)
  wait for what the run before ends with.
* A stack is live afterwards for sure or if one of some stacks was live before. The number of live stacks at a split is hence a base, plus
  the stacks live before that the run had not touched yet, plus one for each condition that holds. Only shapes that can be the largest
  for some start are kept.
"""

from __future__ import annotations

import json
from collections import Counter

#: kind, token, stack, parent, rule, rule_line
Event = tuple
Shape = tuple[int, int, tuple[tuple[int, ...], ...]]
_NOTHING: frozenset = frozenset()


def _add(counts: dict, key: object, n: int, first: int) -> None:
    had = counts.get(key)
    counts[key] = [n, first] if had is None else [had[0] + n, min(had[1], first)]


def _missing(a: tuple, b: tuple) -> int:
    """How many entries of ``a`` have no partner in ``b``."""
    return (Counter(a) - Counter(b)).total() if a != b else 0


class Run:
    """Summary of a run; starts as that of no events."""

    def __init__(self) -> None:
        self.last_line: int | None = None
        self.max_stack = 0
        self.tokens: dict[str, list[int]] = {}
        self.early: list[int] | None = None
        self.token: tuple[str | None] | None = None
        self.rules: dict[tuple, list[int]] = {}
        self.waiting: dict[int, list[int]] = {}
        self.reduced: dict[int, tuple] = {}
        self.effect: dict[int, tuple[bool, frozenset]] = {}
        self.touched: list[int] = []
        self.shapes: list[Shape] = []

    # --- building ---------------------------------------------------------------------------------

    def _after(self, stack: int) -> tuple[bool, frozenset]:
        return self.effect.get(stack, (False, frozenset([stack])))

    def _set(self, stack: int, sure: bool, after: frozenset) -> None:
        if stack not in self.effect:
            self.touched.append(stack)
        self.effect[stack] = (sure, _NOTHING if sure else after)

    def _shape(self, shape: Shape) -> None:
        """Notes the live stacks at a split. A shape that can never be the larger one of two neighbours is left out.

        Each untouched stack and each condition adds at most one.
        """
        base, untouched, conditions = shape
        while self.shapes:
            b, u, c = self.shapes[-1]
            if b - base >= _missing(conditions, c):
                return
            if base - b < untouched - u + _missing(c, conditions):
                break
            self.shapes.pop()
        self.shapes.append(shape)

    def add(self, line: int, event: Event) -> None:
        kind, token, stack, parent, rule, rule_line = event
        self.last_line = line
        if kind == "next_token":
            self.token = (token or None,)
        elif kind == "reduce":
            if stack is not None:
                self.reduced[stack] = (rule, rule_line)
        elif kind == "die":
            if stack is not None:
                self._set(stack, False, _NOTHING)
        elif kind == "rename":
            if stack is not None and parent is not None:
                moved = self._after(parent)
                self._set(parent, False, _NOTHING)
                there = self._after(stack)
                self._set(stack, there[0] or moved[0], there[1] | moved[1])
        elif stack is not None:
            self._split(line, stack, parent)

    def _split(self, line: int, stack: int, parent: int | None) -> None:
        self.max_stack = max(self.max_stack, stack)
        if self.token is None:
            n, first = self.early or (0, line)
            self.early = [n + 1, min(first, line)]
        elif self.token[0] is not None:
            _add(self.tokens, self.token[0], 1, line)
        if parent is None:
            return
        if parent not in self.reduced:
            _add(self.waiting, parent, 1, line)
        elif self.reduced[parent][0] is not None:
            _add(self.rules, self.reduced[parent], 1, line)
        self._set(stack, True, _NOTHING)
        states = self.effect.values()
        conditions = tuple(sorted(tuple(sorted(after)) for _, after in states if after))
        self._shape((sum(sure for sure, _ in states), len(self.touched), conditions))

    # --- merging ----------------------------------------------------------------------------------

    def then(self, later: Run) -> Run:
        """Extends this run by the one that follows it."""
        if later.last_line is not None:
            self.last_line = later.last_line
        self.max_stack = max(self.max_stack, later.max_stack)
        if later.early is not None:
            if self.token is None:
                n, first = self.early or (0, later.early[1])
                self.early = [n + later.early[0], min(first, later.early[1])]
            elif self.token[0] is not None:
                _add(self.tokens, self.token[0], *later.early)
        for key, count in later.tokens.items():
            _add(self.tokens, key, *count)
        for parent, count in later.waiting.items():
            if parent not in self.reduced:
                _add(self.waiting, parent, *count)
            elif self.reduced[parent][0] is not None:
                _add(self.rules, self.reduced[parent], *count)
        for key, count in later.rules.items():
            _add(self.rules, key, *count)
        self.token = later.token or self.token
        self.reduced.update(later.reduced)
        self._then_stacks(later)
        return self

    def _joined(self, stacks: frozenset | tuple) -> tuple[bool, frozenset]:
        """Whether one of ``stacks`` is live after this run."""
        found = [self._after(s) for s in stacks]
        return any(f[0] for f in found), _NOTHING.union(*(f[1] for f in found))

    def _then_stacks(self, later: Run) -> None:
        before = len(self.touched)
        for base, untouched, conditions in later.shapes:
            seen = set(later.touched[:untouched])
            kept = [self.effect[s] for s in self.touched if s not in seen] + [self._joined(c) for c in conditions]
            self._shape((
                base + sum(sure for sure, _ in kept),
                before + sum(s not in self.effect for s in seen),
                tuple(sorted(tuple(sorted(after)) for sure, after in kept if after and not sure)),
            ))
        effects = {s: (True, _NOTHING) if sure else self._joined(after) for s, (sure, after) in later.effect.items()}
        for s in later.touched:
            self._set(s, *effects[s])

    # --- reading ----------------------------------------------------------------------------------

    def peak(self, live: set[int]) -> int:
        """Largest number of live stacks at a split if ``live`` were so before; 0 without splits."""
        sizes = [
            base + len(live.difference(self.touched[:untouched])) + sum(not live.isdisjoint(c) for c in conditions)
            for base, untouched, conditions in self.shapes
        ]
        return max(sizes, default=0)

    def dump(self) -> str:
        return json.dumps([
            self.last_line, self.max_stack, list(self.tokens.items()), self.early, self.token, list(self.rules.items()),
            list(self.waiting.items()), list(self.reduced.items()), [(s, *self._dumped(s)) for s in self.touched], self.shapes,
        ])

    def _dumped(self, stack: int) -> tuple[bool, list[int]]:
        sure, after = self.effect[stack]
        return sure, sorted(after)

    @classmethod
    def load(cls, text: str) -> Run:
        run = cls()
        run.last_line, run.max_stack, tokens, run.early, token, rules, waiting, reduced, effect, shapes = json.loads(text)
        run.tokens, run.waiting = dict(tokens), dict(waiting)
        run.token = None if token is None else tuple(token)
        run.rules = {tuple(k): v for k, v in rules}
        run.reduced = {k: tuple(v) for k, v in reduced}
        run.effect = {s: (sure, frozenset(after)) for s, sure, after in effect}
        run.touched = [s for s, _, _ in effect]
        run.shapes = [(b, u, tuple(tuple(c) for c in cs)) for b, u, cs in shapes]
        return run


def summarize(events: dict[int, Event]) -> Run:
    """Summary of events by line number."""
    run = Run()
    for line in sorted(events):
        run.add(line, events[line])
    return run


def merged(texts: list[str]) -> Run:
    """Summary of neighbouring runs, given as dumped and in order."""
    total = Run()
    for text in texts:
        total.then(Run.load(text))
    return total
