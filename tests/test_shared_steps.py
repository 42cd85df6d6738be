"""What several branches of a plan read is made once, and the rows stay those of the SQL."""

import duckdb
import pytest

from savora.plans import catalogue
from tests.test_catalogue import DIR, TABLES, table

#: A query, and what its plan holds only if a step that it shares is in it again.
AGAIN = {"rank_envelope": "mention_count", "influencer_intrusion": "l_orderkey", "ablation_spearman": "seen_at", "ablation_summary": "seen_at"}


@pytest.mark.parametrize("name", AGAIN)
def test_made_once(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DIR)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert AGAIN[name] not in plan
    assert table(got.toPandas()) == table(con.execute(catalogue.SQL[name]).df())
