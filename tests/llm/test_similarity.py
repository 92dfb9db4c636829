import random

import numpy as np
from pyspark.sql import functions as F


def groups(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    from lexframe.llm.common import components

    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1300)] + [(5, 5), (9, 8), (8, 9), (-3, 8)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[k] == 7 for k in range(1000, 1300)) and got[9] == got[8] == -3
    assert components(df.limit(0)).count() == 0


def test_gray_index_finds_all_pairs():
    from lexframe.llm import simhash as S

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 9, 400)], np.uint64)
    codes = np.unique(np.concatenate([base, base[rng.integers(0, 60, 400)] ^ flips]))
    codes = codes[np.argsort(S.gray_rank(codes))]
    assert S.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))
    group = np.repeat([4, 9], [200, len(codes) - 200])
    got = {(int(a), int(b)) for x, y in S.GrayIndex(codes, group).close_pairs(4) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and bin(int(codes[i] ^ codes[j])).count("1") <= 4}
    assert got == want


def test_simhash_against_brute_force(spark):
    from lexframe.llm import simhash as S

    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(15)]
    texts = []
    for _ in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed" + rng.choice("abc")
        texts.append(" ".join(words))
    docs = [(i + 10, t) for i, t in enumerate(texts)] + [(3, None), (4, ""), (5, " \t"), (6, "One two"), (7, "one  TWO"), (8, "É x y z w"), (10, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).coalesce(2)
    prints = [S.fingerprint(t) for _, t in docs]
    assert prints[90] == prints[91] == prints[92] == 0 and prints[93] == prints[94]
    tops = groups(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    least = {}
    for (i, _), t in zip(docs, tops, strict=True):
        least[t] = min(least.get(t, 10**9), 10**9 if i is None else i)
    want = sorted((i is None, i, f"{p:016x}", least[t]) for (i, _), p, t in zip(docs, prints, tops, strict=True))
    got = S.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert S.near_duplicates(df.limit(0)).count() == 0
    # one row per group with all its columns: smallest doc_id, a null one last, of repeated rows one
    kept = S.representatives(df)
    assert kept.columns == df.columns
    best = {}
    for (i, x), t in zip(docs, tops, strict=True):
        best[t] = min(best.get(t, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(best.values())
    assert S.representatives(df.limit(0)).count() == 0


def test_vectors_against_brute_force(spark):
    from lexframe.llm import vectordup as V

    rng = np.random.default_rng(1)
    centre = rng.standard_normal((8, 32))
    vectors = [(centre[i % 8] + rng.standard_normal(32) * 0.13 * (i % 3)).tolist() for i in range(240)]
    table = [(i, v, i % 2) for i, v in enumerate(vectors)]
    table += [(300, vectors[4], 0), (301, vectors[4], 0), (302, None, 0), (303, [0.0] * 32, 0), (304, [float("nan")] * 32, 0), (305, [None] * 32, 0),
              (306, vectors[4], None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0), (None, vectors[6], 0), (310, [x * 1e300 for x in vectors[4]], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    good = [i for i, (_, v, l) in enumerate(table) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    linked = []
    for i in good:
        for j in good:
            if j < i and table[i][2] == table[j][2] and len(table[i][1]) == len(table[j][1]):
                a, b = (np.array(table[k][1]) / np.abs(table[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    linked.append((i, j))
    assert len(linked) > 300
    tops = groups(len(table), linked)
    least = {}
    for (i, _, _), t in zip(table, tops, strict=True):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    degree = np.bincount([x for p in linked for x in p], minlength=len(table))
    want = sorted((str(i), int(d), least.get(t)) for (i, _, _), d, t in zip(table, degree, tops, strict=True))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in V.near_duplicates(df).collect()) == want
    assert V.near_duplicates(df.limit(0)).count() == 0


def test_flip_sets_are_all_subsets():
    from lexframe.llm.vectordup import flips

    values = np.array([0.5, 0.1, 0.2, 0.4, 0.15])
    want = sorted(m for m in range(32) if sum(values[k] for k in range(5) if m >> k & 1) <= 0.5 + 1e-12)
    assert sorted(flips(values, 0.5 + 1e-12)) == want


def test_decontamination(spark):
    from lexframe.llm import decontam as D

    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ble", "ing", "st", "ou"]) for _ in range(rng.randint(2, 5)))
    common = ["the", "of", "and", "it", "is"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(k, " ".join(prose(30)) + ". " + " ".join(prose(8)) + ".") for k in range(20)]
    items += [(20, items[3][1]), (21, None), (22, ""), (None, "lost words here")]
    docs, truth = [], {}
    for i in range(60):
        words = prose(rng.randint(50, 400))
        truth[i] = set()
        if i % 3 == 0:
            k = rng.randrange(20)
            hidden = items[k][1].split()
            if i % 2:  # a paraphrase: some words go, some are exchanged
                hidden = [word() if rng.random() < 0.1 else w for w in hidden if rng.random() > 0.05]
            at = rng.randrange(len(words))
            words[at:at] = hidden
            truth[i] = {k} | ({3, 20} if k == 3 else set())
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "the of and"), (103, items[0][1]), (103, "clean"), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).coalesce(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find(df, bench).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(set(r._items))
    assert all(by[i] == [truth[i]] for i in range(60))
    assert sorted(map(len, by[103])) == [0, 1] and by[None] == [{1}] and by[100] == by[101] == by[102] == [set()]
    assert D.decontaminate(df, bench).columns == df.columns
    assert D.find(df, bench.limit(0)).filter("size(_items) > 0").count() == 0 and D.find(df.limit(0), bench).count() == 0
    # latent retrieval finds what comparing everything with everything finds
    brute = {i for i, t in docs[:60] for k, x in items[:20] if D.lcs(D.words_of(x), D.words_of(t)) / len(D.words_of(x)) >= 0.8}
    assert len([i for i in brute if by[i][0]]) >= 0.9 * len(brute)


def test_lcs():
    from lexframe.llm.decontam import lcs

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(a, b) == t[-1][-1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    words = {"en": "the of and with this from that have".split(), "de": "der die und nicht über mit von ist".split()}
    text = lambda l: "\n".join(" ".join(rng.choice(words[l]) + rng.choice(["", "a", "b"]) for _ in range(12)) for _ in range(6))
    docs = [(i, text(l), l, f"s{i % 3}", 0) for i in range(60) for l in [("en", "de")[i % 2]]]
    docs += [(60, docs[3][1], "de", None, None), (61, None, "en", "s", 0), (62, "1234", None, "s", 4), (3, docs[3][1], "de", "s0", 0)]
    item = " ".join(f"rare{k}word" for k in range(20)) + "."
    docs.append((63, docs[4][1].replace("\n", "x\n") + "\n" + item, "en", "s", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("clash")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, df = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for name, stage in P.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        out[name] = df
        assert name == "packing" or df.columns == columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in out.items()}
    assert ids["language_id"] == sorted([*range(61), 3, 63])
    assert ids["line_dedup"] == sorted([*range(60), 63])
    assert set(ids["near_dedup"]) <= set(ids["line_dedup"]) and len(ids["near_dedup"]) == len(set(ids["near_dedup"]))
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {63} & set(ids["near_dedup"])
    assert set(ids["packing"]) == set(ids["decontamination"])
    assert out["line_dedup"].filter("n_chars <> length(text)").count() == 0
    assert P.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(ids["decontamination"])


def test_decontamination_finds_an_item_that_a_third_of_the_documents_hold(spark):
    from lexframe.llm import decontam as D

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    frequent, seldom = [word() for _ in range(15)], [word() for _ in range(55)]
    items = [(1, " ".join(frequent)), (2, " ".join(seldom))] + [(k, " ".join(word() for _ in range(30))) for k in range(3, 40)]
    docs, truth = [], {}
    for i in range(300):  # all other words are of no item
        words = [word() for _ in range(rng.randint(60, 300))]
        truth[i] = [1] if i % 3 == 0 else [2] if i % 50 == 1 else []
        at = rng.randrange(len(words))
        words[at:at] = {1: frequent, 2: seldom}.get(sum(truth[i]), [])
        docs.append((i, " ".join(words)))
    found = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r._items for r in found.collect()} == truth


def test_decontamination_retrieves_in_the_latent_space_alone(spark, monkeypatch):
    from lexframe.llm import decontam as D

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    stock, common = [word() for _ in range(4000)], ["the", "of", "and", "it", "is", "to"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(stock) for _ in range(n)]
    items = [(k, " ".join(prose(rng.choice([12, 25, 90]))) + ". " + " ".join(prose(8)) + ".") for k in range(60)]
    docs = []
    for i in range(150):
        words = prose(rng.choice([3, 31, 32, 33, 64, 65, 200]))
        if i % 3:
            told = items[rng.randrange(60)][1].split()
            kept = 0.6 if i % 3 == 1 else 0.3  # of the question's words, with the answer whole
            at = rng.randrange(len(words))
            words[at:at] = [w if rng.random() < kept else rng.choice(stock) for w in told[:-8]] + told[-8:]
        docs.append((i, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    find = lambda: {(r.doc_id, k) for r in D.find(df, bench).collect() for k in r._items}
    got = find()

    def everything(self, parts):
        _, place, start = self.windows(parts)
        n = len(self.items)
        return np.tile(place, n), np.tile(start, n), np.repeat(np.arange(n), len(place))

    latent = D.fit(df, [(k, t, None) for k, t in items], bench)
    with monkeypatch.context() as all_pairs:
        all_pairs.setattr(D.Latent, "retrieved", everything)
        brute = {(i, k) for (i, _), found in zip(docs, latent.matches([t for _, t in docs]), strict=True) for k in found}
    assert len(brute) > 80 and got <= brute and len(got) >= 0.9 * len(brute)
    with monkeypatch.context() as small:
        small.setattr(D, "GROUP", 100)
        small.setattr(D, "CELLS", 50)
        assert {(i, k) for (i, _), found in zip(docs, latent.matches([t for _, t in docs]), strict=True) for k in found} == got
        small.setattr(D, "MAX_WORDS", 1500)  # several parts
        parts = find()
    assert parts <= brute and len(parts) >= 0.9 * len(brute)
    monkeypatch.setattr(D, "factor", lambda passages, n_words, rank=D.RANK: np.zeros((n_words, rank)))
    assert not find()


def test_words_of_ascii_texts_and_others():
    import re

    from lexframe.llm.decontam import words_of

    plain = "".join("a_Z9"[i % 4] + chr(i) for i in range(128)) + "".join(map(chr, range(128)))
    for text in (plain, plain + "é \u00a0ß²\u2028x", "K\u212a-K", "", " ", "one"):
        assert words_of(text) == re.findall(r"\w+", text.lower())
    assert words_of(None) == []


def test_windows_add_the_words_of_each_half_once():
    from lexframe.llm import decontam as D

    rng = np.random.default_rng(3)
    weight, factor = rng.random(11), rng.random((10, 4))
    latent = D.Latent({str(i): i for i in range(10)}, np.ones(11), weight, factor)
    parts = [rng.integers(-1, 10, n) for n in (1, 31, 32, 33, 64, 65, 96, 97, 200)]
    z, place, start = latent.windows(parts)
    want = [(p, s, ids[s: s + D.WINDOW]) for p, ids in enumerate(parts) for s in range(0, max(1, len(ids) - D.STRIDE), D.STRIDE)]
    assert [(int(p), int(s)) for p, s in zip(place, start, strict=True)] == [(p, s) for p, s, _ in want]
    for got, (_, _, ids) in zip(z, want, strict=True):
        f, n = D._once_a_half(ids)
        assert np.allclose(got, (n * weight[f]) @ factor[f], atol=1e-4)
