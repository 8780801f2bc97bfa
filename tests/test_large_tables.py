"""What larger tables showed: queries against DuckDB, on events made by hand."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from skein.plans import archive, assembly

#: The first moment of the driver's events, in microseconds; dense() divides times by 200.
START = 1_704_067_200_000_000


def both(spark, tmp_path, module, name, events):
    """Rows of a query and of its SQL over events of (event_id, seconds of dense(), user_id, event_type, value, k)."""
    ids, seconds, users, types, values, ks = zip(*events, strict=True)
    t = pa.table({
        "event_id": pa.array(ids, pa.int64()),
        "ts": pa.array([START + round(s * 200e6) for s in seconds], pa.timestamp("us")),
        "user_id": pa.array(users, pa.int64()),
        "event_type": types,
        "value": pa.array(values, pa.float64()),
        "props": [f'{{"k": {k}}}' for k in ks],
    })
    pq.write_table(t, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(module.SQL[name])
    columns = [c[0] for c in want.description]
    got = module.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    return sorted(map(tuple, got)), sorted(want.fetchall())


def test_speakers_whose_segments_have_no_length(spark, tmp_path):
    events = [(1, 10.0, 5, "view", 20.0, 0), (2, 15.0, 5, "click", 0.0, 2), (3, 16.0, 5, "error", 4.0, 3)]
    got, want = both(spark, tmp_path, assembly, "event_speaker_seconds", events)
    assert got == want == [(1, 2, 0.0), (1, 3, 4.0)]


def test_rows_of_an_item_that_start_together_on_two_media(spark, tmp_path):
    events = [(0, 5.0, 1, "error", 100.0, 1), (10, 20.0, 1, "view", 5.0, 1), (11, 20.0, 2, "view", 5.0, 1), (12, 30.0, 1, "view", 5.0, 1), (13, 30.0, 1, "view", 900.0, 1)]
    got, want = both(spark, tmp_path, assembly, "visible_rows", events)
    assert got == want == [(5, True), (6, False)]


def test_windows_do_not_follow_the_order_of_a_sum(spark, tmp_path):
    # as doubles added in this order: 30.000000000000156 and 1200.0000000000002
    short, long = [0.1] * 300, [0.1] * 300 + [1170.0]
    assert sum_in_order(short) > 30 and sum_in_order(long) > 1200
    events = [(i, float(i), user, "view", v, 1) for user, values in ((1, short), (2, long)) for i, v in enumerate(values)]
    for d, rows in (("up", events), ("down", events[::-1])):
        (tmp_path / d).mkdir()
        tumbling, _ = both(spark, tmp_path / d, archive, "tumbling_windows", rows)
        assert [sum(r[0] == user for r in tumbling) for user in (1, 2)] == [1, 40]
        hopping, _ = both(spark, tmp_path / d, archive, "hopping_windows", rows)
        assert hopping == [(1, 0, 0.0, 30.0), (2, 0, 0.0, 1200.0)]


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total
