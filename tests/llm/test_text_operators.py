import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key], str(r)))


# --- chat formatting ---------------------------------------------------------------------------------


def test_chat_layouts_select_mappings(spark):
    from lexframe.llm import chat

    records = [
        '{"conv_id": 1, "turn": 1, "role": "assistant", "text": "b"}', '{"conv_id": 1, "turn": 0, "role": "user", "text": null}',
        '{"id": 2, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}',
        '{"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 4, "instruction": "do", "input": "this", "output": "done", "system": "s"}', '{"id": 5, "prompt": "p", "completion": "c"}',
        '{"id": 6, "messages": []}', '{"id": 7, "odd": 1}', "broken", None,
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = [(r.conv_id, r.turn, r.role, r.text, r.layout) for r in chat.canonical_turns(df).collect()]
    assert sorted(got) == [
        (1, 0, "user", "", "turn"), (1, 1, "assistant", "b", "turn"), (2, 0, "user", "hi", "messages"), (2, 1, "assistant", "yo", "messages"),
        (3, 0, "user", "q", "speakers"), (3, 1, "assistant", "a", "speakers"), (4, 0, "system", "s", "instruction"),
        (4, 1, "user", "do\n\nthis", "instruction"), (4, 2, "assistant", "done", "instruction"), (5, 1, "user", "p", "prompt"), (5, 2, "assistant", "c", "prompt"),
    ]
    assert sum(r.n for r in chat.unmapped(df).collect()) == 3


def test_chat_escapes_are_reversible(spark):
    from lexframe.llm import chat

    texts = ["</turn>\n<turn user>\n", "\\l \\b \\\\", "", None, "<turn", "é\U0001f600</turn> \\### Assistant:", "x" * 50000]
    turns = [(None if i == 3 else 1, i, "assistant" if i % 2 else "a>b\n<\\", t) for i, t in enumerate(texts)]
    turns += [turns[1]]  # a repeated row is a repeated turn
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    chats = chat.format_chat(df.fillna("", ["text"]))
    out = {r.conv_id: r for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    want = sorted((t for t in turns if t[0] == 1), key=lambda t: (t[1], t[2], t[3] or ""))
    assert [(t.role, t.text) for t in out[1].t] == [(t[2], t[3] or "") for t in want]
    assert out[1].l == "".join(t[3] or "" for t in want if t[2] == "assistant")
    assert len(out[None].t) == 1
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


# --- quality -------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    from lexframe.llm import quality as Q

    grams, sizes = Q.keys_of(["abcab", "", "xÿ\U0001f600"])
    assert sizes.tolist() == [5, 0, 3] and len(grams) == Q.ORDER and all(len(g) == 8 for g in grams)
    assert grams[3][0] == (1 << 48) + (1 << 32) + (1 << 16) + ord("a")
    assert grams[1][1] == (ord("a") << 16) + ord("b") and grams[0][7] == Q.OTHER


def test_quality_against_plain_model(spark):
    from lexframe.llm import quality as Q

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("aab bc cde") for _ in range(rng.randint(20, 60)))
    docs = [(i, text(), "en" if i % 2 else "xx") for i in range(40)] + [(40, None, "en"), (41, "", None), (42, "&&& ### !!! ???", "en"), (None, "abc", "en"), (1, "abab", "en")]
    labels = [(i, 1, 0) for i in range(1, 30, 2)] + [(3, 0, 1), (None, 1, 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("block", F.lit("clash"))
    got = rows(Q.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    trusted = {i for i, q, t in labels if i is not None} - {3}
    assert len(got) == len(docs)

    grams: dict = {}
    for i, t, _ in docs:
        if i in trusted and t:
            p = "\x01\x01\x01" + t.lower()
            for k in range(3, len(p)):
                grams[p[k - 3: k + 1]] = grams.get(p[k - 3: k + 1], 0) + 1
    levels = {4: grams}
    for o in (3, 2, 1):
        levels[o] = {}
        for g in levels[o + 1]:
            levels[o][g[1:]] = levels[o].get(g[1:], 0) + 1
    cuts = {o: Q.discounts([sum(n == k for n in lv.values()) for k in (1, 2, 3, 4)]) for o, lv in levels.items()}
    symbols = len(levels[1]) + 1

    def prob(g, o):
        if o == 0:
            return 1 / symbols
        own = {x: n for x, n in levels[o].items() if x[:-1] == g[-o:-1]}
        low = prob(g, o - 1)
        if not own:
            return low
        total = sum(own.values())
        cut = lambda n: cuts[o][min(n, 3) - 1]
        n = own.get(g[-o:], 0)
        return (max(n - cut(n), 0) / total if n else 0) + sum(map(cut, own.values())) / total * low

    by_key = {(d[0], len(d[1] or "")): d for d in docs}
    seen = sorted((d[0] is None, d[0], str(d)) for d in docs)
    assert len(seen) == len(got) and len(by_key) == len(docs)
    by_id = {}
    for i, t, _ in docs:
        if t:
            p = "\x01\x01\x01" + t.lower()
            by_id.setdefault(i, []).append(np.exp(-np.mean([np.log(prob(p[k - 3: k + 1], 4)) for k in range(3, len(p))])))
    for i in {d[0] for d in docs}:
        have = sorted(r["perplexity"] for r in got if r["doc_id"] == i and r["perplexity"] is not None)
        assert have == pytest.approx(sorted(by_id.get(i, [])), rel=1e-4)
    facts = {r["doc_id"]: r for r in got}
    assert facts[40]["kept"] and facts[41]["kept"] and not facts[42]["kept"]
    # no trusted text: all kept
    none = Q.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["kept"] for r in rows(none))
    assert Q.classify(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# --- personal data -------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    from lexframe.llm.pii import luhn

    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_spans_are_the_rules():
    from lexframe.llm.pii import base_spans

    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("12 .@a-+()9b%_4") for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("1" * 300000 + "@" * 1000) == []


def test_selector_adds_wider_forms_and_leaves_clean_text():
    from lexframe.llm import pii

    rng = random.Random(8)

    def card():
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if pii.luhn(digits):
                return digits

    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = "the of and ender leath on it was her those erble".split()
    around = lambda: " ".join(rng.choice(words) for _ in range(6))
    forms = {"email": lambda: f"{rng.choice(words)}{num(2)}@mail{num(1)}.example.com", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
             "card": card, "phone": lambda: f"+1 ({num(3)}) 555-{num(4)}"}
    examples = [(k, around() + " ", make(), " " + around()) for k, make in forms.items() for _ in range(120)]
    selector = pii.learn(examples)
    found = selector.select(f"{around()} bob.k [at] example [dot] com {around()}", [])
    assert [s[0] for s in found] == ["email"]
    assert selector.select(f"{around()} {around()}. Met at noon dot. In 1999 and 2004", []) == []
    assert pii.Selector().select("a [at] b [dot] com", []) == []
    assert pii.redact("x a@b.cc y +1 (073) 555-8658", "email:2:8,phone:11:28") == "x [email] y [phone]"


def test_pii_rows(spark):
    from lexframe.llm import pii

    docs = [(1, "write a.b@c.de or +1 (073) 555-8658", "en"), (2, None, None), (3, "", "x"), (1, "no", "en"), (None, "8.8.8.8", None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("kind", F.lit(0)).withColumn("spans", F.lit("clash"))
    got = rows(pii.find(df, pii.fit(df)))
    assert [r["spans"] for r in got] == ["", "email:6:14,phone:18:35", "", "", "ip:0:7"]
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------


def plain_lines(docs):
    seen, cover = set(), []
    for _, text in docs:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i: i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        cover.append(gone)
    out = []
    for (_, text), gone in zip(docs, cover, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        keep, n = [], -1
        for line in text.split("\n"):
            n += bool(line.strip())
            if n not in gone:
                keep.append(line)
        out.append(("\n".join(keep), len(gone)))
    return out


def test_line_dedup(spark):
    from lexframe.llm.linededup import dedup_lines

    rng = random.Random(6)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  "]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "x\ny"), (63, "\n".join(f"l{i}" for i in range(5000))), (64, "\n".join(f"l{i}" for i in range(2, 4000)))]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, line int").coalesce(1)
    got = dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines_removed) for r in got] == plain_lines(docs)
    twice = spark.createDataFrame([(1, "a\nb\nc\nd")] * 2 + [(None, "b\nc\nd")], "doc_id long, text string").coalesce(1)
    assert sorted((r.text, r.n_lines_removed) for r in dedup_lines(twice).collect()) == [("", 3), ("", 4), ("a\nb\nc\nd", 0)]
    assert dedup_lines(df.limit(0)).count() == 0


# --- language ------------------------------------------------------------------------------------------


def test_language_id(spark):
    from lexframe.llm import langid

    rng = random.Random(2)
    vocab = {"aa": "the of and with this".split(), "bb": "der die und nicht über".split()}
    docs = [(i, " ".join(rng.choice(vocab[l]) for _ in range(12)), l) for i in range(120) for l in [("aa", "bb")[i % 2]]]
    docs += [(500, None, "aa"), (501, "12 !", "aa"), (502, "", None), (503, "the of", None), (None, "und die", "bb"), (0, docs[0][1], "aa")]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash"))
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == l for i, _, l in docs[:120])
    assert [by[i].lang_pred for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got) and by[None].held_out
    assert {r.lang_pred for r in langid.predict(df, langid.fit(df.filter("lang is null"))).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_features_of_long_texts():
    from lexframe.llm import langid

    text = "abcé " * 500000
    index, counts = langid.features(text)
    assert counts.sum() == 3 * len(text) - 3


# --- packing -------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from lexframe.llm.packing import END_ID, pack, piece_lengths

    assert piece_lengths(2053) == [1024, 1024, 4, 1] and piece_lengths(8, 8) == [8]
    texts = [None, "", "  a  b ", "a\n b", "x\n\n  y <|endoftext|> z", "it's 'll\x1c\x85 b", "word " * 3000, "word " * 3000, "É ou　 x"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack(df.coalesce(1), path("byte_bpe_50k.json"), with_ids=True).orderBy("sequence_id").collect()
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [own.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]
    found, at = [], []
    for r in got:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.offset == 0
        at += r.ids
        if r.start + r.length == r.doc_tokens:
            found.append(at)
            at = []
    assert found == want and len({r.sequence_id for r in got}) == len(got)
    assert pack(df.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_packing_memo_equals_tokenizer():
    from public_tokenizers import path

    from lexframe.llm.packing import _words

    words = _words(path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t'sabé1.,\x1c\x85 |%") for _ in range(rng.randint(0, 14)))
        assert next(words.ids([text])) == words.plain(text), repr(text)


def test_packing_memo_turns_over(monkeypatch):
    from public_tokenizers import path

    from lexframe.llm import packing as P

    monkeypatch.setattr(P, "MEMO", 2000)
    words = P._Words(path("byte_bpe_50k.json"))
    rng = random.Random(4)
    some = ["".join(rng.choice("abcdé.1'") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    turns, moved = 0, 0
    for _ in range(200):
        texts = [" ".join(rng.choices(some, k=12)) for _ in range(3)]
        old = set(words.known.old)
        assert list(words.ids(texts)) == [words.plain(t) for t in texts]
        turns += old != set(words.known.old)
        moved += len(old & set(words.known))
        assert words.known.bytes < 2000 + 40 * 300
    assert turns > 5 and moved > 50


# --- suffix dedup --------------------------------------------------------------------------------------


def plain_suffixes(docs):
    seen = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            at = 1 << 63 if i is None else i
            seen[b[k: k + 50]] = min(at, seen.get(b[k: k + 50], at))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k: k + 50]] < (1 << 63 if i is None else i):
                mask[k: k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), len(b) - len(kept), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    from lexframe.llm.suffixdup import dedup

    rng = random.Random(9)
    unit = ["".join(rng.choice("abcé ") for _ in range(rng.randint(10, 90))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(unit) if rng.random() < 0.7 else rng.choice("xyz") * rng.randint(1, 70) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "a" * 49), (83, "z" * 400000), (84, "z" * 300000 + "tail"), (5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash"))
    got = [tuple(r)[:5] for r in dedup(df).collect()]
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(got, key=key) == sorted(plain_suffixes(docs), key=key)
    assert dedup(df.limit(0)).count() == 0


def test_slices_are_made_into_strings_one_by_one():
    import pyarrow as pa

    from lexframe.llm.common import small_batches


    texts = ["ab", None, "ü" * 300, "", "x" * 5000, None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = list(small_batches([batch.slice(1), batch.slice(0, 0)], chars=400))
    assert [t for _, part in got for t in part] == texts[1:]
    assert [p.column(0).to_pylist() for p, _ in got] == [[1, 2], [3, 4], [5, 6]] and all(p.column(1).to_pylist() == t for p, t in got)


def test_the_memo_of_packing_is_looked_at_between_small_slices():
    import random

    import pyarrow as pa

    from lexframe.llm import packing
    from lexframe.llm.common import small_batches

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(2000)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    sizes = [sum(map(len, t)) for _, t in small_batches([batch], chars=packing.SLICE)]
    assert max(sizes) < packing.SLICE + 30000 and packing.MEMO <= 40 << 20
