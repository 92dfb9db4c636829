"""Some registered queries against their SQL counterparts on the smallest tables."""

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents pages".split()
NAMES = [
    "page_scripts", "token_counts", "asi_points", "adjacency_errors", "imports", "calls", "methods",
    "error_type_counts", "log_sorted_by_size", "split_parent_rule", "topk_split_rules", "module_edges",
    "module_reach", "trace_compare", "run_delta", "operators", "templates", "identifier_cardinality", "nesting_quantiles", "bracket_match",
]


def _rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return round(v, 9) if isinstance(v, float) else v

    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    import pandas as pd

    spark_frame = pd.DataFrame([r.asDict() for r in entry.queries()[name](spark, SF).collect()], dtype=object)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    oracle = pd.DataFrame(cursor.fetchall(), columns=columns, dtype=object)
    assert sorted(spark_frame.columns) == sorted(columns)
    assert _rows(spark_frame) == _rows(oracle)


def test_every_query_has_sql():
    from lexframe.plans.oracle_queries import all_statements
    from lexframe.plans.registry import queries

    assert set(queries()) == set(all_statements())
