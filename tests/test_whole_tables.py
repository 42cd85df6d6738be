"""Registered queries over whole tables: a city with a single shop."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from savora.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_city_list_knows_every_city(spark, tmp_path):
    for f in os.listdir(DIR):
        if f != "part.parquet":
            os.symlink(f"{DIR}/{f}", tmp_path / f)
    part = pq.read_table(f"{DIR}/part.parquet")
    row = part.slice(0, 1).to_pylist()[0] | {"p_partkey": 700_000, "p_brand": "Brand#lone"}
    pq.write_table(pa.concat_tables([part, pa.Table.from_pylist([row], schema=part.schema)]), tmp_path / "part.parquet")
    got = {r.city: r.restaurant_count for r in catalogue.QUERIES["city_list_full_outer"](spark, str(tmp_path)).collect()}
    assert got.get("Brand#lone") == 1
