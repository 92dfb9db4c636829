from lexframe.functions.paths import normalize
from lexframe.operators import modules as M
from pyspark.sql import functions as F


def graph(spark, exports, stars, imports, paths):
    scripts = spark.createDataFrame([(p, p) for p in paths], "script_id string, path string")
    rows = [(s, i, n, None, False, None) for i, (s, n) in enumerate(exports)] + [(s, i, None, None, True, t) for i, (s, t) in enumerate(stars)]
    exp = spark.createDataFrame(rows, "script_id string, pos int, exported string, alias string, is_all boolean, source string")
    imp = spark.createDataFrame([(s, i, n, n, t) for i, (s, n, t) in enumerate(imports)], "script_id string, pos int, local string, imported string, source string")
    return M.module_edges(imp, exp, scripts)


def test_edges(spark):
    paths = ["a/a.js", "a/b.js", "a/c.js", "a/d.js", "e.js"]
    stars = [("a/a.js", "./b.js"), ("a/b.js", "./x/../c.js"), ("a/c.js", "./d.js"), ("a/d.js", "./a.js")]
    exports = [("a/a.js", "own"), ("a/d.js", "far"), ("a/d.js", "default")]
    imports = [("e.js", "own", "./a/a.js"), ("e.js", "far", "./a/./a.js"), ("e.js", "default", "./a/a.js"), ("e.js", "gone", "./a/a.js"),
               ("e.js", None, "./a/../a/b.js"), ("e.js", "x", "lib"), ("e.js", "x", "./no.js"), ("a/a.js", "far", "../a/b.js"), ("a/a.js", None, "../../../e.js")]
    got = {r.pos: (r.status, r.target_script) for r in graph(spark, exports, stars, imports, paths).filter("script_id = 'e.js'").collect()}
    assert got == {0: ("resolved", "a/a.js"), 1: ("resolved_star", "a/d.js"), 2: ("unresolved", "a/a.js"), 3: ("unresolved", "a/a.js"),
                   4: ("module", "a/b.js"), 5: ("external", None), 6: ("missing", None)}
    rest = {r.pos: (r.status, r.target_path) for r in graph(spark, exports, stars, imports, paths).filter("script_id = 'a/a.js'").collect()}
    assert rest == {7: ("resolved_star", "a/b.js"), 8: ("module", "e.js")}


def test_reach_has_no_cap(spark):
    n = 45
    links = [(f"m{i}", f"m{i + 1}") for i in range(n)] + [("m3", "m1"), ("z", "z")]
    edges = spark.createDataFrame(links, "path string, target_path string")
    got = {(r.src, r.dst): r.depth for r in M.module_reach(edges, edges.filter("path in ('m0', 'z')")).collect()}
    assert got == {("m0", f"m{i}"): i for i in range(1, n + 1)} | {("z", "z"): 1}
    short = spark.createDataFrame(links[:4] + links[-2:], "path string, target_path string")
    counts = {r.src: (r.n_reached, r.farthest) for r in M.reach_counts(M.module_reach(short)).collect()}
    assert counts == {"m0": (4, 4), "m1": (4, 3), "m2": (4, 3), "m3": (4, 3), "z": (1, 1)}


def test_paths(spark):
    cases = {"a/./b//c.js": "a/b//c.js", "/a/../b": "/b", "../x": "x", "a/b/../../c/.": "c", "": "", "./m.js": "m.js"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert df.select(normalize(F.col("p")).alias("got"), "want").filter("got <> want").collect() == []
