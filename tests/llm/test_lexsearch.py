import math
import random
import re

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, top):
    """All scores of all documents, straight from the formulas."""
    rows = [(d, [w.translate(LOWER) for w in WORD.findall(t or "")]) for d, t in docs]
    rows = [r for r in rows if r[1]]
    n_docs, total = len(rows), sum(len(w) for _, w in rows)
    df = {}
    for _, words in rows:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(w.translate(LOWER) for w in WORD.findall(t or ""))
    out = []
    for i, want in terms.items():
        scored = []
        for d, words in rows:
            m = 100 - 50 + ((50 * len(words) * n_docs) // total)
            score = 0
            for w in want:
                if tf := words.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda s: s[:3])
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:top])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Été", "ÉTÉ", "x1", "X1", "日本", "co-op"]
    pick = lambda k: " ".join(rng.choice(words[: rng.choice([5, 40, len(words)])]) for _ in range(k))
    items = [(i, pick(rng.randint(1, 25))) for i in range(12)]
    docs = [(i * 3 % 101 + i, pick(rng.choice([1, 3, 20, 80, 300]))) for i in range(n)]
    docs += [(1000 + i, "some copy of w1 w2 w3 " + items[3][1]) for i in range(70)]  # more equal texts than ranks
    return docs, items


def test_ranking_equals_all_scores(spark):
    from lexframe.llm import lexsearch as S

    docs, items = corpus(1, 260)
    docs += [(5, None), (6, ""), (7, "-- ,;"), (None, items[4][1]), (None, None), (8, items[4][1]), (8, items[4][1]), (9, "w1 " * 30000)]
    items += [(50, None), (51, "..."), (52, "unknown words only"), (53, "w1"), (53, "w7 w1"), (None, "w3 w9"), (54, "A" * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as item_id").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    want = plain(docs, items, 50)
    assert rows_of(S.search(d, i)) == want
    # several chunks, buckets, and vectors beyond the seeds
    assert rows_of(S.search(d, i, seeds=20, chunk=40, bucket=16)) == want
    assert rows_of(S.search(d, i, top=3, seeds=30, chunk=64, bucket=8)) == plain(docs, items, 3)
    assert S.search(d.limit(0), i).count() == 0 and S.search(d, i.limit(0)).count() == 0
    assert S.search(d, i.filter("item_id = 51")).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    from lexframe.llm import lexsearch as S

    docs, items = corpus(2, 120)
    monkeypatch.setattr(S, "ITEMS", 5)
    monkeypatch.setattr(S, "BLOCK", 30)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(S._item_blocks(i))) > 3
    assert rows_of(S.search(d, i)) == plain(docs, items, 50)


def test_bounds_prune_and_lose_nothing():
    from lexframe.llm import lexsearch as S

    rng = np.random.default_rng(4)
    # long vectors first: they set the threshold that short ones cannot reach
    lists = [np.sort(rng.choice(60, rng.integers(1, 5 if i > 100 else 40), replace=False)) for i in range(900)]
    lists = [np.append(x, 60 + i % 3) if i < 60 else x for i, x in enumerate(lists)]  # terms that short vectors lack
    table = pa.table({"doc_id": pa.array(np.arange(900)), "n": pa.array(np.full(900, 30)), "terms": pa.array(lists, pa.list_(pa.int32())),
                      "tfs": pa.array([rng.integers(1, 9, len(x)) for x in lists], pa.list_(pa.int64()))})
    weight = rng.integers(1, 9000, 63)
    chunk = S._Chunk(table, weight, (900, 27000))
    flat = np.concatenate([np.sort(rng.choice(60, 12, replace=False)) for _ in range(6)] + [[60, 61, 62]])
    starts = np.arange(0, 84, 12)
    state = S._Search(flat, starts, weight, np.ones(7, np.int64), 10)
    for bucket in chunk.buckets(np.arange(900), 32):
        state.add(bucket)
    scores = np.zeros((7, 900), np.int64)
    for q in range(7):
        member = np.isin(chunk.term, flat[starts[q]: starts[q] + 12])
        scores[q] = np.bincount(chunk.row[member], chunk.impact[member], 900).astype(np.int64)
        best = sorted(zip((-scores[q]).tolist(), range(900)))[:10]
        got = sorted(zip((-state.best[q][0]).tolist(), state.best[q][1].tolist()))
        assert got == best
    assert state.counts["by_norm"] > 0 and state.counts["by_bounds"] > 0
    assert state.counts["survivors"] < state.counts["documents"] / 2
