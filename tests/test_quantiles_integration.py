"""Quantiles of real data agree with DuckDB, whatever the number of pieces."""

import duckdb
import pytest

from splitscope.checks.oracle import CLEAN_CTES, q
from splitscope.operators.quantiles import exact_quantiles
from splitscope.plans import pipeline
from splitscope.spec import NOTEBOOK_SPEC as NB

SF = "/root/testdata/sf0.01"


def test_quantiles_match_duckdb_on_few_and_many_pieces(spark):
    clean = pipeline.clean_sessions(spark, SF, NB, materialized=True)
    qs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for kind, fn in (("disc", "QUANTILE_DISC"), ("cont", "QUANTILE_CONT")):
        want = {r[0]: r[1:] for r in con.sql(q(CLEAN_CTES, f"""
            SELECT ab_cohort_name, {fn}(publisher_revenue, 0.05), {fn}(publisher_revenue, 0.5),
                   {fn}(publisher_revenue, 0.95) FROM valid_sessions GROUP BY 1""")).fetchall()}
        for parts in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = exact_quantiles(clean, ["ab_cohort_name"], "publisher_revenue", qs, kind).collect()
            assert len(got) == len(want)
            for r in got:
                for i, name in enumerate(qs):
                    assert getattr(r, name) == pytest.approx(want[r.ab_cohort_name][i], rel=1e-12), (kind, parts)
