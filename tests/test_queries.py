"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from zoneforge import queries

#: A part of the queries, of every family; the driver compares all of them.
SOME = (
    "ingest_mmcif read_domain_ranges write_clusters write_dataset unpack_atoms dataset_fingerprint eval_log config_drift label_drift check_fk set_equality dense_index "
    "check_elements smooth_density interpolate_density atoms_within zone_neighbors subchain_pairs annotate_domains build_assembly select_novel_zones connected_groups allocate_splits "
    "split_summary stream_annotations stream_curriculum classification_metrics align_vectors nearest_direction sample_direction_near neighbor_frames batch_plan rasterize image_pair flagship pick_training_zones stream_pick principal_axes zone_grid_principal make_samples make_curriculum"
).split()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes, datetime.datetime)):
        return repr(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return repr({k: plain(v) for k, v in x.items()})
    return repr([plain(v) for v in x])


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_every_name_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(queries.queries()) > 110
