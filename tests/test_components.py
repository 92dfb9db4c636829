import random

import pytest

from lexframe.operators import components as C


def _closure(links):
    onward = {}
    for a, b in links:
        onward.setdefault(a, set()).add(b)
    reach = {}
    for start in {n for link in links for n in link}:
        seen, todo = set(), list(onward.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += onward.get(n, ())
        reach[start] = seen
    return reach


def _check(spark, links):
    edges = spark.createDataFrame(links, "path string, target_path string")
    reach = _closure([link for link in links if None not in link])
    found = C.strong_components(edges)
    rows = found.collect()
    got = {r.path: (r.component, r["size"], r.cyclic) for r in rows}
    assert len(rows) == len(got)
    want = {}
    for a, seen in reach.items():
        group = {b for b in seen if a in reach[b]} | {a}
        want[a] = (min(group), len(group), a in seen)
    assert got == want
    return edges, found, reach


@pytest.mark.parametrize("seed,n,m", [(1, 30, 45), (3, 25, 90)])
def test_components_and_sizes_of_random_graphs(spark, seed, n, m):
    rnd = random.Random(seed)
    links = [(f"m{rnd.randrange(n):02d}", f"m{rnd.randrange(n):02d}") for _ in range(m)]
    edges, found, reach = _check(spark, links + links[:3])
    sizes = {r.path: r.n_reached for r in C.reach_sizes(edges, found).collect()}
    assert sizes == {a: len(seen) for a, seen in reach.items()}


def test_odd_edges(spark):
    """Self loops, repeated and null ends, two rings joined one way, a tail."""
    links = [("a", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "t"), ("t", "u"), (None, "a"), ("x", None)]
    _check(spark, links)
    empty = spark.createDataFrame([], "path string, target_path string")
    none = C.strong_components(empty)
    assert none.collect() == [] and C.reach_sizes(empty, none).collect() == []


def test_rings_and_chains(spark):
    """A ring where every module has one way out, tails into it, a ring with a second way out, chains entered halfway."""
    ring = [(f"m{i:03d}", f"m{(i + 1) % 100:03d}") for i in range(100)]
    tails = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(20)] + [("t20", "m050"), ("s", "t03"), ("s", "r"), ("r", "s")]
    round_trip = [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(30)] + [("x30", "y"), ("y", "x07"), ("y", "z"), ("z", "y"), ("w", "x02"), ("w", "x29"), ("z", "w0")]
    _check(spark, ring + tails + round_trip)
