"""Column expressions over numpy arrays with SQL's nulls, and windows over rows that are in order already.

A column is a ``V``: values and, if some are null, which are not. Names (kinds, classes, rules) are small numbers in one table of the process, so that
comparing them is comparing numbers. ``Rows`` are rows in the order of ``script, pos``. A window over them sorts by its other keys alone, stably, and no
rows are moved: its functions give numbers of rows or sums. As in SQL, a window up to the current row reaches over rows with the same position.
"""

from __future__ import annotations

import operator
from functools import cached_property, lru_cache

import numpy as np

_CODES: dict[str, int] = {}
_MOST = 1 << 10


def code(name: str) -> int:
    return _CODES.setdefault(name, len(_CODES))


def names_of() -> list[str]:
    """Names by their number."""
    return list(_CODES)


@lru_cache(maxsize=None)
def _table(names: tuple[str, ...]) -> np.ndarray:
    table = np.zeros(_MOST, bool)
    table[[code(n) for n in names]] = True
    return table


def _both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a & b


class V:
    """Values and where they are not null (``None``: everywhere). True is never kept for a null."""

    __slots__ = ("v", "ok")
    __hash__ = None

    def __init__(self, v: np.ndarray, ok: np.ndarray | None = None):
        self.v, self.ok = v, ok

    def _test(self, other, op) -> V:
        if isinstance(other, V):
            ok, found = _both(self.ok, other.ok), op(self.v, other.v)
        else:
            ok, found = self.ok, op(self.v, code(other) if isinstance(other, str) else other)
        return V(found if ok is None else found & ok, ok)

    def __eq__(self, other):
        return self._test(other, operator.eq)

    def __ne__(self, other):
        return self._test(other, operator.ne)

    def __lt__(self, other):
        return self._test(other, operator.lt)

    def __gt__(self, other):
        return self._test(other, operator.gt)

    def __ge__(self, other):
        return self._test(other, operator.ge)

    def _sum(self, other, op) -> V:
        if isinstance(other, V):
            return V(op(self.v, other.v), _both(self.ok, other.ok))
        return V(op(self.v, other), self.ok)

    def __add__(self, other):
        return self._sum(other, operator.add)

    def __sub__(self, other):
        return self._sum(other, operator.sub)

    def __and__(self, other):
        if self.ok is None and other.ok is None:
            return V(self.v & other.v)
        known = _both(self.ok, other.ok) | self._no() | other._no()
        return V(self.v & other.v, known)

    def __or__(self, other):
        v = self.v | other.v
        ok = _both(self.ok, other.ok)
        return V(v, None if ok is None else ok | v)

    def __invert__(self):
        return V(self._no(), self.ok)

    def _no(self) -> np.ndarray:
        return ~self.v if self.ok is None else self.ok & ~self.v

    def isin(self, *names: str) -> V:
        found = _table(names)[self.v]
        return V(found if self.ok is None else found & self.ok, self.ok)

    def null(self) -> V:
        return V(np.zeros(len(self.v), bool) if self.ok is None else ~self.ok)

    def there(self) -> V:
        return V(np.ones(len(self.v), bool) if self.ok is None else self.ok)


def true(c: V) -> V:
    return V(c.v)


def case(*arms: tuple[V, object], other=None) -> V:
    """The value of the first arm whose test is true; names, numbers, columns or ``None`` (null)."""
    values = [x for _, x in arms] + [other]
    kinds = [x.v.dtype if isinstance(x, V) else np.int16 if isinstance(x, str) else np.bool_ if isinstance(x, bool) else np.int32 for x in values if x is not None]
    dtype = np.result_type(*kinds)
    n = len(arms[0][0].v)
    v, ok = np.zeros(n, dtype), np.zeros(n, bool)
    for test, x in [(None, other), *reversed(arms)]:
        if x is None:
            x, there = dtype.type(0), False
        elif isinstance(x, V):
            x, there = x.v, True if x.ok is None else x.ok
        else:
            x, there = dtype.type(code(x) if isinstance(x, str) else x), True
        if test is None:
            v[:], ok[:] = x, there
        else:
            v, ok = np.where(test.v, x, v), np.where(test.v, there, ok)
    if ok.all():
        return V(v)
    return V(v & ok if dtype == np.bool_ else v, ok)


def either(a: V, b) -> V:
    """The first that is not null."""
    return case((a.there(), a), other=b)


def at(row: V, column: V) -> V:
    """The column's value in the rows with these numbers."""
    ok = row.ok if column.ok is None else _both(row.ok, column.ok[row.v])
    v = column.v[row.v]
    return V(v & ok if ok is not None and v.dtype == np.bool_ else v, ok)


class Rows:
    """Rows in the order of ``script`` and ``pos``."""

    def __init__(self, script: np.ndarray, pos: np.ndarray):
        self.n, self.script, self.at_pos = len(script), script, pos

    @cached_property
    def tied(self) -> bool:
        return bool(((self.at_pos[1:] == self.at_pos[:-1]) & (self.script[1:] == self.script[:-1])).any())

    @cached_property
    def by_pos(self) -> Window:
        return Window(self, None)

    def window(self, *keys: np.ndarray) -> Window:
        key = np.zeros(self.n, np.int64)
        for k in keys:
            if self.n:
                low, high = int(k.min()), int(k.max())
                key = key * (high - low + 1) + (k - low)
        return Window(self, key)

    def subset(self, kept: np.ndarray) -> Rows:
        return Rows(self.script[kept], self.at_pos[kept])


class Window:
    """Rows of one script with equal keys, by position."""

    def __init__(self, rows: Rows, key: np.ndarray | None):
        n = rows.n
        self.n, self.key = n, key
        script, pos = rows.script, rows.at_pos
        if key is None:
            self.order = None
        else:
            if n and key.max() < 1 << 15:
                key = key.astype(np.int16)  # sorted by digits
            self.order = np.argsort(key, kind="stable")
            script, pos, key = script[self.order], pos[self.order], key[self.order]
        self.first = np.ones(n, bool)
        self.first[1:] = script[1:] != script[:-1]
        if key is not None:
            self.first[1:] |= key[1:] != key[:-1]
        at_ = np.arange(n, dtype=np.int32)
        self.at_ = at_
        self.start = np.maximum.accumulate(np.where(self.first, at_, 0)) if n else at_
        self.peers = None
        if rows.tied:
            ends = np.ones(n, bool)
            ends[:-1] = self.first[1:] | (pos[1:] != pos[:-1])
            self.peers = np.minimum.accumulate(np.where(ends, at_, n - 1)[::-1])[::-1]

    @cached_property
    def end(self) -> np.ndarray:
        """The last of each group, by sorted number."""
        ends = np.ones(self.n, bool)
        ends[:-1] = self.first[1:]
        return np.minimum.accumulate(np.where(ends, self.at_, self.n - 1)[::-1])[::-1] if self.n else self.at_

    def _in(self, v: np.ndarray) -> np.ndarray:
        return v if self.order is None else v[self.order]

    def _out(self, v: np.ndarray) -> np.ndarray:
        if self.order is None:
            return v
        out = np.empty_like(v)
        out[self.order] = v
        return out

    def _rows(self, found: np.ndarray, ok: np.ndarray) -> V:
        """Row numbers from sorted numbers."""
        found = np.where(ok, found, 0)
        return V(self._out(found if self.order is None else self.order[found]), self._out(ok)) if self.n else V(found, ok)

    def before(self, k: int = 1) -> V:
        """The row ``k`` rows before."""
        return self._rows(self.at_ - k, self.at_ - k >= self.start)

    def behind(self, k: int = 1) -> V:
        return self._rows(self.at_ + k, self.at_ + k <= self.end)

    def lag(self, column: V, k: int = 1) -> V:
        if self.order is not None:
            return at(self.before(k), column)
        v, ok = np.zeros_like(column.v), self.at_ - k >= self.start
        v[k:] = column.v[: self.n - k] if k < self.n else v[k:]
        if column.ok is not None and k < self.n:
            ok[k:] &= column.ok[: self.n - k]
        return V(v & ok if v.dtype == np.bool_ else v, ok)

    def lead(self, column: V, k: int = 1) -> V:
        if self.order is not None:
            return at(self.behind(k), column)
        v, ok = np.zeros_like(column.v), self.at_ + k <= self.end
        if k < self.n:
            v[: self.n - k] = column.v[k:]
            if column.ok is not None:
                ok[: self.n - k] &= column.ok[k:]
        return V(v & ok if v.dtype == np.bool_ else v, ok)

    def last(self, test: V, *, own: bool = True) -> V:
        """The last row up to here (without ``own``: before here) that passes the test."""
        if not self.n:
            return V(self.at_, test.v)
        found = np.maximum.accumulate(np.where(self._in(test.v), self.at_, -1))
        if not own:
            found = np.concatenate([found[:1] * 0 - 1, found[:-1]])
        elif self.peers is not None:
            found = found[self.peers]
        return self._rows(found, found >= self.start)

    @cached_property
    def back(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers from behind, rows of one position in their order as a sort by falling position leaves them, and the first place of each's group."""
        run = self.at_ if self.peers is None else self.peers
        q = np.lexsort([self.at_, -run])
        group = self.start[q]
        return q, np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, self.at_, 0))

    def next(self, test: V) -> V:
        """The first row behind here that passes the test."""
        if not self.n:
            return V(self.at_, test.v)
        if self.peers is not None:
            q, start = self.back
            found = np.maximum.accumulate(np.where(self._in(test.v)[q], self.at_, -1))
            found = np.concatenate([[-1], found[:-1]])
            ok = np.empty(self.n, bool)
            ok[q] = found >= start
            at_ = np.zeros(self.n, np.int32)
            at_[q] = q[np.maximum(found, 0)]
            return self._rows(at_, ok)
        found = np.minimum.accumulate(np.where(self._in(test.v), self.at_, self.n)[::-1])[::-1]
        found = np.concatenate([found[1:], [self.n]])
        return self._rows(found, found <= self.end)

    def _sums(self, v: np.ndarray) -> np.ndarray:
        total = np.cumsum(self._in(v), dtype=np.int64)
        return total - (total[self.start] - self._in(v)[self.start])

    def sum(self, v: np.ndarray) -> np.ndarray:
        """Sum up to here."""
        if not self.n:
            return v.astype(np.int64)
        total = self._sums(v)
        return self._out(total if self.peers is None else total[self.peers])

    def sum_behind(self, v: np.ndarray) -> np.ndarray:
        """Sum of the rows behind here; zero without any."""
        if not self.n:
            return v.astype(np.int64)
        if self.peers is not None:
            q, start = self.back
            own = self._in(v)[q]
            total = np.cumsum(own, dtype=np.int64) - own
            out = np.empty(self.n, np.int64)
            out[q] = total - total[start]
            return self._out(out)
        total = self._sums(v)
        return self._out(total[self.end] - total)

    def max(self, column: V, *, own: bool = True) -> V:
        """The greatest up to here (without ``own``: before here)."""
        if not self.n:
            return column
        v = self._in(column.v).astype(np.int64)
        there = np.ones(self.n, bool) if column.ok is None else self._in(column.ok)
        low = int(v.min())
        step = int(v.max()) - low + 2
        group = np.cumsum(self.first, dtype=np.int64) - 1
        if step * (int(group[-1]) + 1) < 1 << 62:
            # later groups are higher than all of earlier ones
            found = np.maximum.accumulate(np.where(there, v - low + 1, 0) + group * step) - group * step
        else:
            found, k = np.where(there, v - low + 1, 0), 1
            while k < self.n:
                found[k:] = np.where(self.at_[k:] - k >= self.start[k:], np.maximum(found[k:], found[:-k]), found[k:])
                k *= 2
        if not own:
            found = np.where(self.first, 0, np.concatenate([[0], found[:-1]]))
        elif self.peers is not None:
            found = found[self.peers]
        return V(self._out(found + low - 1), self._out(found > 0))

    def min(self, column: V) -> V:
        found = self.max(V(-column.v.astype(np.int64), column.ok))
        return V(-found.v, found.ok)
