"""No signal and no position changes when later rows arrive: every such query over ticks that end early, and over all of them."""

import os

import duckdb
import pytest

import __spark_entry__

from .conftest import SF

QUERIES = __spark_entry__.queries()
#: Labels (SIG-10 to SIG-13) look ahead by their meaning and are used for training only; the others have no time column.
NAMES = sorted(n for n in QUERIES if n.startswith(("sig", "pf")) and n.split("_")[0] in ("sig0", "sig1", "sig2", "sig3", "sig4", "sig6", "sig7", "sig8", "pf1", "pf2", "pf3", "pf4", "pf5"))
END = "2024-01-24 00:00:00"


@pytest.fixture(scope="module")
def early(tmp_path_factory):
    path = tmp_path_factory.mktemp("early")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", path / name)
    duckdb.execute(f"copy (select * from '{SF}/events.parquet' where ts <= timestamp '{END}') to '{path}/events.parquet'")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_later_rows_change_nothing(spark, early, name):
    run = QUERIES[name]
    before, after = (run(spark, d).filter(f"ts_us < unix_micros(timestamp '{END}') - 7200000000").cache() for d in (early, SF))
    assert before.count() > 0 and before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_later_events_change_no_drift(spark, early):
    """SIG-9 is stamped with its entry."""
    before, after = (QUERIES["sig9_event_drift"](spark, d).filter(f"entry_us < unix_micros(timestamp '{END}') - 7200000000") for d in (early, SF))
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
