"""One row for each key, whatever the number and size of the repeated keys."""

import pytest

from garimpo.operators import latest


@pytest.mark.parametrize(("most", "size"), [(0, 1 << 20), (100, 1 << 20), (100, 1)])
def test_one_row_a_key(spark, monkeypatch, most, size):
    monkeypatch.setattr(latest, "BROADCAST_BYTES", size)
    rows = [("a", 1, 1), ("a", 1, 2), ("a", None, 1), ("a", None, 3), (None, 1, 4), (None, 1, 2), (None, None, 5), (None, None, 6), ("b", None, 1), ("c", 2, None), ("c", 2, 7)]
    df = spark.createDataFrame(rows, "k string, p int, q int")
    got = sorted((tuple(x) for x in latest.latest_rows(df, ["k", "p"], "q", broadcast_keys=most).collect()), key=str)
    assert got == sorted([("a", 1, 2), ("a", None, 3), (None, 1, 4), (None, None, 6), ("b", None, 1), ("c", 2, 7)], key=str)
    assert latest.latest_rows(df.limit(0), ["k", "p"], "q", broadcast_keys=most).count() == 0
