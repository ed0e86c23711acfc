"""Queries against their SQL where the result hangs on a small difference: near and equal values, thresholds met exactly."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vocalith.plans import ORACLES, QUERIES

from .oracle import rows

START = datetime(2024, 1, 1)


def events(folder, made, rows_a_group=1 << 20):
    """(event_id, user_id, event_type, value), one a second, as events.parquet in ``folder``."""
    ids, users, kinds, values = zip(*made, strict=True)
    ts = pa.array([START + timedelta(seconds=i) for i in range(len(made))], pa.timestamp("us"))
    t = pa.table({"event_id": pa.array(ids, pa.int64()), "ts": ts, "user_id": pa.array(users, pa.int64()), "event_type": kinds, "value": pa.array(values, pa.float64())})
    pq.write_table(t, f"{folder}/events.parquet", row_group_size=rows_a_group)
    return str(folder)


def both(spark, name, folder, table="events"):
    """Rows of the query and of its SQL, which runs on one thread as its sums would else hang on the threads."""
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = c.execute(ORACLES[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = QUERIES[name](spark, folder)
    return rows(df.columns, [tuple(r) for r in df.collect()]), want


def test_argmax_frame_weighs_numbers_that_lie_far_apart(spark, tmp_path):
    got, want = both(spark, "argmax_frame", events(tmp_path, [(5, 1, "view", 9.99), (500_000, 1, "view", 10.0), (7, 2, "view", 9.0), (500_001, 2, "view", 10.0)]))
    assert got == want == [("5.000000", "view", "1.000000", "10.000000"), ("500001.000000", "view", "2.000000", "10.000000")]


def test_decisions_where_scores_meet_thresholds(spark, tmp_path):
    made = [(pair, metric, (8 + (pair * metric * 3) % 5 - 2) / 100) for pair in range(1, 400) for metric in range(1, 8)] + [(pair, m, 0.05) for pair in range(401, 440) for m in range(1, pair % 7 + 1)]
    pairs, metrics, discounts = zip(*made, strict=True)
    pq.write_table(pa.table({"l_suppkey": pa.array(pairs, pa.int64()), "l_linenumber": pa.array(metrics, pa.int32()), "l_discount": pa.array(discounts, pa.float64())}), f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, "decisions", str(tmp_path), "lineitem")
    assert got == want


def test_peak_regularity_where_distances_vary_by_just_the_limit(spark, tmp_path):
    made = []
    for user, gaps in enumerate([(3, 7, 3, 7), (7, 3, 7, 3), (3, 3, 7, 7), (3, 7, 7, 3), (7, 3, 3, 7), (6, 14, 6, 14, 6, 14), (3, 7, 3, 7, 3, 7, 7, 3), (6, 14, 14, 6, 3, 7, 3, 7), (4, 3, 7, 2, 6, 8, 5), (8, 2, 8, 6, 4, 4, 4, 3, 6, 7, 3), (3, 5, 7, 9, 5, 3, 3, 5), (4, 3, 3, 7, 6, 4, 6, 9, 3), (5, 7, 5, 7)]):
        tops = {2 + sum(gaps[:i]) for i in range(len(gaps) + 1)}
        made += [(len(made) + t, user, "view", 200.0 if t in tops else 50.0) for t in range(max(tops) + 3)]
    got, want = both(spark, "peak_regularity", events(tmp_path, made))
    assert got == want and {r[2] for r in got} == {"True", "False"}


def test_spectral_peaks_without_plateaus(spark, tmp_path):
    values = [0, 200, 200, 0, 10, 220, 0, 300, 300, 300, 0, 170, 20, 400, 400, 0]
    got, want = both(spark, "spectral_peaks", events(tmp_path, [(i, 1, "view", float(v)) for i, v in enumerate(values)]))
    assert got == want and [r[0] for r in got] == ["11.000000", "5.000000"]


def on_edges(folder):
    """Events in many row groups; the values of each user, in whole cents, have a mean that is a threshold of some query."""
    r, made = random.Random(3), []
    for user in range(1200):
        n, edge = r.randint(8, 24), (2000, 3000, 5000, 8000, 18000, 30000)[user % 6]
        cents = [edge + r.randint(1, edge // 2) * s for _ in range(n // 2) for s in (1, -1)]
        values = [edge, *[a + d for a, d in zip(cents, (d for x in [r.randint(0, 300) for _ in cents[::2]] for d in (x, -x)), strict=True)]]
        r.shuffle(values)
        made += [(user, v / 100) for v in values]
    r.shuffle(made)
    return events(folder, [(7 * i + 5, user, "view", v) for i, (user, v) in enumerate(made)], 500)


@pytest.mark.parametrize("name", ["combined_modification", "file_modification", "pitch_features", "spoof_summary"])
def test_means_that_meet_thresholds(spark, tmp_path, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got, want = both(spark, name, on_edges(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
