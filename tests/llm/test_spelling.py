import random
import re
from zlib import crc32

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs):
    counts = {}
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    forms, rows = {}, {}
    for w, n in counts.items():
        close = sorted((-counts[v], v) for v in counts if edits(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        forms[w] = form
        rows[w] = [form, None, n, len(close), counts[form] if form else None]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows[w][1] = root
    return {(w, *r) for w, r in rows.items()}


def test_variants_against_brute_force(spark, monkeypatch):
    from lexframe.llm import spelling as S

    rng = random.Random(3)
    letters = "abcdeéñÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = list(base)
    for _ in range(3):  # variants of variants
        for w in list(words)[:150]:
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]]))
    weights = [rng.choice([1, 2, 5, 12, 40]) for _ in words]
    docs = [(i, " ".join(rng.choices(words, weights, k=60)) + rng.choice([" ", "-", "1", "日"]) + rng.choice(words).upper()) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "12 ... 日本"), (None, "Hello hello hello HELLO"), (7, docs[7][1]), (503, ("z" * 5000 + " ") * 3 + ("z" * 5001 + " ") * 9)]
    docs += [(600 + i, "common words common words common wordz " * 50) for i in range(40)]
    want = plain(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n").repartition(3)
    rows = S.variants(df)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in rows.collect()} == want
    assert len([1 for r in want if r[1] and r[2] != r[1]]) > 3  # chains of forms
    # many small chunks give the same
    monkeypatch.setattr(S, "CHUNK", 64)
    monkeypatch.setattr(S, "FLUSH", 10)
    monkeypatch.setattr(S, "CELLS", 8)
    assert {tuple(r) for r in S.variants(df).collect()} == want
    assert S.variants(df.limit(0)).count() == 0


def test_partner_blocks_cover_every_edit():
    import numpy as np

    from lexframe.llm import spelling as S

    group = S.letter_groups()
    key = lambda w: np.bincount(group[np.frombuffer(w, np.uint8)], minlength=S.GROUPS)
    steps = set(S._partners())
    rng = random.Random(8)
    alphabet = S._LETTER
    for _ in range(400):
        w = bytes(rng.choice(alphabet) for _ in range(8))
        at = rng.randrange(8)
        other = rng.choice([w[:at] + w[at + 1:], w[:at] + bytes([rng.choice(alphabet)]) + w[at + 1:]])
        d = tuple((key(w) - key(other)).tolist())
        assert d in steps or tuple(-x for x in d) in steps
        assert not (d in steps and tuple(-x for x in d) in steps and any(d))  # a pair is met once


def test_distances_and_edits():
    from lexframe.llm import spelling as S

    same = [b"abcde", b"abcdf", b"edcba", b"abxde", b"bacde"]
    pairs = {(same[i], same[j]) for x, y in S.near(S.Block(same), S.Block(same), True) for i, j in zip(x, y)}
    assert pairs == {(b"abcde", b"abcdf"), (b"abcde", b"abxde")}
    longer = [b"abcdee", b"aabcde", b"abdcee"]
    pairs = {(same[i], longer[j]) for x, y in S.near(S.Block(same), S.Block(longer), False) for i, j in zip(x, y)}
    assert pairs == {(b"abcde", b"abcdee"), (b"abcde", b"aabcde")}
