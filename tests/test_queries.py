import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
from oracle import connect, differences  # noqa: E402

from sparktide.plans.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CON = connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SF, CON) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 * 720
    assert set(entry.oracle_sql()) <= set(entry.queries())
