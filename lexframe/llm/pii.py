"""Personal data: rules give the base spans; generators propose further spans, boosted trees and calibrated thresholds select among them.

Base spans are leftmost and non-overlapping per kind. Proposals are wider forms of the same kinds (spelled-out addresses, numbers
with other separators or without the plus) and may overlap. The trees see the format of a proposal and its context. They learn from a
bounded sample: base spans of ``SAMPLE`` documents at most, rewritten in wider forms (positive) and broken in ways that no
longer are personal data (negative). A kind's threshold is the least one with precision ``PRECISION`` on rows not learned from. A proposal is
selected at or above its threshold, best first, if it overlaps neither a base span nor a selected one.

Edge cases: a null text is empty and has no spans; long texts are searched whole, in linear time; repeated rows are searched each for
itself; without any base span in the table nothing can be learned and only base spans return. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.boosting import BoostedTrees
from lexframe.llm.common import map_batches, small_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000  # documents to learn from
PRECISION = 0.99
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit after a digit starts no match: what the earlier one cannot match, it cannot either
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    if not _ANY.search(text):
        return []
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


_GENERATORS = (
    ("email", ("[at]", "(at)", "[dot]", "(dot)", " dot "),
     re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,5}")),
    ("ip", (), re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\.|:) ?[0-9]{1,3}){3}(?![0-9])")),
    ("card", (), re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{2,6}){2,4}(?![0-9])")),
    ("card", (), re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", (), re.compile(r"(?<![0-9])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
)


def proposals(text: str, base: list[Span]) -> list[Span]:
    """Spans of the wider forms that overlap no base span."""
    digits = _DIGIT.search(text) is not None
    out = set()
    for kind, marks, pattern in _GENERATORS:
        if any(m in text for m in marks) if marks else digits:
            out |= {(kind, *m.span()) for m in pattern.finditer(text)}
    return sorted((s for s in out if not any(s[1] < b[2] and b[1] < s[2] for b in base)), key=_place) if len(base) < 64 else \
        _apart(sorted(out, key=_place), base)


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    edges = sorted((b[1], b[2]) for b in base)
    starts = np.array([e[0] for e in edges])
    ends = np.maximum.accumulate([e[1] for e in edges])
    at = np.searchsorted(starts, [s[2] for s in spans])
    return [s for s, k in zip(spans, at, strict=True) if k == 0 or ends[k - 1] <= s[1]]


_CUES = {  # words near a span that speak for or against a kind
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobil"), "other": ("token", "version", "page", "order", "invoice", "date", "id", "http"),
}


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    kind, start, end = span
    body = text[start:end]
    digits = "".join(_DIGIT.findall(body))
    groups = re.findall(r"[0-9]+", body)
    before, after = text[max(0, start - CONTEXT): start], text[end: end + CONTEXT]
    near = (before + " " + after).lower()
    left, right = before[-1:], after[:1]
    return [
        *[float(kind == k) for k in KINDS], len(body), len(digits), len(digits) / len(body), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), float(bool(digits) and luhn(digits)),
        float(bool(groups) and all(map(_small, groups))), sum(c.isalpha() for c in body), body.count(" "), body.count("."), body.count("-"),
        body.count("/"), body.count("("), body.count("["), body.count(":"), float("at" in body.lower()), float("dot" in body.lower()),
        float(body[:1] == "0"), float(bool(re.search(r"(?:19|20)[0-9]{2}", body))),
        float(left.isalnum()), float(right.isalnum()), float(left == " "), float(right == " "), float(left in "\"'=#$v"), float(right in "%\"'"),
        sum(c.isdigit() for c in near) / max(1, len(near)), *[float(any(w in near for w in words)) for words in _CUES.values()],
    ]


def _wider(kind: str, body: str) -> list[str]:
    digits = "".join(_DIGIT.findall(body))
    if kind == "email":
        # also without digits, which the forms do not need
        pairs = [b.partition("@")[::2] for b in (body, re.sub("[0-9]+", "", body))]
        return [form for user, host in pairs for form in (
            f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host}", f"{user} at {host.replace('.', ' dot ')}")]
    if kind == "ip":
        return [body.replace(".", "[.]"), body.replace(".", " . ")]
    if kind == "card":
        return [".".join(digits[i: i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i: i + 4] for i in range(0, len(digits), 4))]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{digits[:-10] or '1'} {local[:3]} {local[3:6]} {local[6:]}"]


def _broken(kind: str, body: str) -> list[str]:
    digits = "".join(_DIGIT.findall(body)) or "1"
    other = str((int(digits[-1]) + 1) % 10)
    if kind == "email":
        return ["look at home dot dot", "met at noon dot"]
    if kind == "ip":
        return ["12.05.2021.3", f"9{body.split('.')[0]}[.]{'[.]'.join(body.split('.')[1:])}", "10:22:31:055"]
    if kind == "card":
        whole = digits[:-1] + other
        return [whole, ".".join(whole[i: i + 4] for i in range(0, len(whole), 4)), digits[:13]]
    return [f"20{digits[-2:]} {digits[:4]}-{digits[4:8]}", f"{digits[:3]} {digits[3:6]}.{digits[6:10]}", f"19{digits[:2]}-1999 2001"]


class Selector:
    """Trees with a threshold per kind; without trees it selects nothing."""

    def __init__(self, trees: BoostedTrees | None = None, limits: dict[str, float] | None = None):
        self.trees, self.limits = trees, limits or {}

    def select(self, text: str, base: list[Span]) -> list[Span]:
        if self.trees is None:
            return []
        found = proposals(text, base)
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, s) for s in found]))
        best = sorted((-q, *_place(s), s) for q, s in zip(p.tolist(), found, strict=True) if q >= self.limits.get(s[0], 2.0))
        chosen: list[Span] = []
        for *_, span in best:
            if len(_apart([span], chosen)) if chosen else True:
                chosen.append(span)
        return chosen


def learn(examples: list[tuple[str, str, str, str]]) -> Selector:
    """From base spans as (kind, text before, span, text after)."""
    x, y, kinds = [], [], []
    for kind, before, body, after in examples:
        for label, forms in ((1, _wider(kind, body)), (0, _broken(kind, body))):
            for form in forms:
                text = before + form + after
                for span in proposals(text, []):
                    inside = span[1] >= len(before) and span[2] <= len(before) + len(form)
                    if inside or (span[1] < len(before) + len(form) and span[2] > len(before)):
                        whole = label and span[0] == kind and span[1:] == (len(before), len(before) + len(form))
                        x.append(features(text, span))
                        y.append(float(whole))
                        kinds.append(span[0])
    if len(set(y)) < 2 or len(y) < 40:
        return Selector()
    values, truth, of = np.array(x), np.array(y), np.array(kinds)
    mixed = np.random.default_rng(11).permutation(len(truth))
    values, truth, of = values[mixed], truth[mixed], of[mixed]
    trees = BoostedTrees().fit(values, truth)
    rest = np.arange(len(truth)) % 4 == 3
    p = trees.probability(values)
    limits = {}
    for kind in KINDS:
        own = rest & (of == kind)
        for limit in np.arange(0.5, 1.0, 0.01):
            taken = own & (p >= limit)
            if taken.any() and truth[taken].mean() >= PRECISION:
                limits[kind] = float(limit)
                break
    return Selector(trees, limits)


def fit(docs: DataFrame, size: int = SAMPLE) -> Selector:
    """Learns from the ``size`` documents with the smallest hashes of doc_id among those with a digit or an ``@``."""
    some = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).distinct()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, start, end in base_spans(text)[:8]:
                    rows.append((doc_id, kind, text[max(0, start - CONTEXT): start], text[start:end][:256], text[end: end + CONTEXT]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield {"doc_id": pa.array(columns[0], pa.int64())} | {n: pa.array(columns[i + 1], pa.string()) for i, n in enumerate(("kind", "a", "b", "c"))}

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id", "left_semi")  # size ids
    rows = map_batches(texts, examples, "doc_id long, kind string, a string, b string, c string").limit(8 * size).collect()
    return learn([(r.kind, r.a, r.b, r.c) for r in sorted(rows, key=lambda r: (r.doc_id, r.kind, r.a, r.b, r.c))])


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """``doc_id, text`` -> ``doc_id``, base counts ``n_*``, ``base`` and ``spans`` as ``kind:start:end`` lists, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in small_batches(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base_text, all_text = [], []
            for text in texts:
                base = base_spans(text or "")
                every = sorted(base + selector.select(text or "", base), key=_place)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                base_text.append(",".join(f"{k}:{a}:{b}" for k, a, b in base))
                all_text.append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
            yield {"doc_id": batch.column(0), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()},
                   "base": pa.array(base_text, pa.string()), "spans": pa.array(all_text, pa.string())}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one stands for both."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at: int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
