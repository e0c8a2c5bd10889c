"""Every registered analytics query that SQL can state, against DuckDB."""

import math

import duckdb
import pytest

from wayfold.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted([tuple(plain(r[k]) for k in order) for r in found.fetchall()], key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_density_levels_of_all_levels(spark):
    rows = QUERIES["density_levels_all"](spark, FOLDER).collect()
    assert {r["grid_id"].split("_")[0] for r in rows} == {"L8", "L10", "L12", "L15"}
    assert len({r["grid_id"] for r in rows}) == len(rows) == QUERIES["grid_cells"](spark, FOLDER).count()


def test_time_axis_markers_of_all_kinds(spark):
    kinds = {(r["marker_type"], r["entity_type"]) for r in QUERIES["time_axis_markers_all"](spark, FOLDER).select("marker_type", "entity_type").distinct().collect()}
    assert kinds == {("SEGMENT_START", "SEGMENT"), ("SEGMENT_END", "SEGMENT"), ("STAY", "STAY"), ("EVENT", "SPEED_EVENT"), ("EVENT", "ALTITUDE_EVENT")}
