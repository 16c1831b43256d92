import pytest

from sparktide.plans.queries import QUERIES, events

SF = "/root/testdata/sf0.001"
WHOLE = ["dwt_round_trip_events", "lof_events", "fft_abs_events", "value_repair_screen_events"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_point_of_every_series_is_there(spark, name):
    count = lambda df: sorted((r[0], r[1]) for r in df.groupBy("user_id").count().collect())
    assert count(QUERIES[name](spark, SF)) == count(events(spark, SF))
