"""Mentions that share the number of their line are all aligned."""

import duckdb

from savora.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_align_keeps_mentions_that_share_a_line(spark):
    lines = ", ".join(f"{t} AS (SELECT * FROM '{DIR}/{t}.parquet')" for t in ("lineitem", "orders", "part"))
    want = duckdb.sql(f"WITH {lines} SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 37 = 0)").fetchall()[0][0]
    got = catalogue.QUERIES["align_in_order"](spark, DIR).collect()
    assert len(got) == len({r.mid for r in got}) == want
    fuzzy = catalogue.QUERIES["fuzzy_align"](spark, DIR).collect()
    assert len(fuzzy) == len({r.mid for r in fuzzy}) <= want
