import random
from collections import defaultdict
from zlib import crc32

from pyspark.sql import functions as F


def corpus(spark, n=400):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([3, 40, 200, 900]) + str(i), rng.choice(["en", "fr", None]), f"s{rng.randrange(6)}", float(i)) for i in range(n)]
    rows += [(1000 + i, "a copied text " * 20, "en", "s1", 1.0) for i in range(n // 2)]  # a third of the rows
    rows += [(2000, None, None, None, None), (2001, "", "", "", float("nan")), (None, "no id", "en", "s0", float("inf")), (2002, "é" * 3000, "fr", "s2", 0.0)]
    rows += [(3000, "one row, again and again", "en", "s3", 5.0)] * 60
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").selectExpr("*", "9 as shard", "7 as size").repartition(3)


def plain_tree(rows, leaves):
    """The tree over collected points: sorted keys, the cut nearest to the wanted bytes."""
    ranges = None
    cells, out = {0: (rows, leaves)}, defaultdict(list)
    while cells:
        after = {}
        for first, (some, k) in sorted(cells.items()):
            if k == 1 or not some:
                for r in some:
                    out[(r.doc_id, r.tie)].append(first)
                continue
            low, high = ([f(r.at[d] for r in some) for d in range(len(some[0].at))] for f in (min, max))
            spans = [b - a for a, b in zip(low, high)]
            ranges = ranges or spans
            dim = max(range(len(spans)), key=lambda d: spans[d] / ranges[d] if ranges[d] else 0.0)
            scale = ((1 << 20) - 1) / spans[dim] if spans[dim] else 0.0
            key = lambda r: (min(max(int((r.at[dim] - low[dim]) * scale), 0), (1 << 20) - 1) << 40) | r.tie  # noqa: B023, E731
            weights = defaultdict(int)
            for r in some:
                weights[key(r)] += r.size
            wanted, total = sum(weights.values()) * (k // 2) / k, 0
            for at in sorted(weights):
                if total + weights[at] >= wanted:
                    cut = at + (total + weights[at] - wanted < wanted - total)
                    break
                total += weights[at]
            after[first] = ([r for r in some if key(r) < cut], k // 2)
            after[first + k // 2] = ([r for r in some if key(r) >= cut], k - k // 2)
        cells = after
    return out


def test_tree_against_brute_force(spark):
    from lexframe.llm import sharding as S
    from lexframe.sources.workdir import written

    _, docs = corpus(spark)
    points = written(S.points(docs, ("lang", "source", "score", "missing")), "points")
    assert len(points.head().at) == 4
    for leaves in (8, 5, 1):
        got, levels = S.grow(points, leaves, tolerance=0.0)
        want = plain_tree(points.collect(), leaves)
        found = defaultdict(list)
        for r in got.collect():
            found[(r.doc_id, r.tie)].append(r.shard)
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        assert len(levels) == {8: 3, 5: 3, 1: 0}[leaves]


def test_shards_are_even_and_slots_gapless(spark):
    from lexframe.llm import sharding as S

    rows, docs = corpus(spark)
    got = S.shard(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), size(t), crc32((t or "").encode())) for i, t, *_ in rows)
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in got:
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(bytes_.values()) / 8
    assert sorted(bytes_) == list(range(8)) and all(abs(b - mean) <= 6001 for b in bytes_.values())  # the largest document
    assert max(bytes_.values()) - min(bytes_.values()) < 0.2 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the copied text is parted only where a cell ends in it
    assert len({r.shard for r in got if r.doc_id and 1000 <= r.doc_id < 1200}) <= 4
    parts = S.shard(docs, target_bytes=sum(bytes_.values()) // 20)
    assert parts.select("shard").distinct().count() in (20, 21)
    assert S.shard(docs.limit(0)).count() == 0
    few = S.shard(docs.filter("doc_id in (5, 6)")).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 2


def test_written_shards_hold_the_documents(spark, tmp_path):
    from lexframe.llm import sharding as S

    rows, docs = corpus(spark)
    S.write_shards(docs, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "text", "lang", "source").exceptAll(docs.select("doc_id", "text", "lang", "source")).count() == 0
    assert back.count() == len(rows)
    sums = [r.b for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).collect()]
    assert len(sums) == 4 and max(sums) - min(sums) < 0.2 * sum(sums) / 4
