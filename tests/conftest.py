import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollcast.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)
PANEL = "unique_id bigint, ds timestamp_ntz, y double"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(i: int) -> datetime:
    """The i-th point of a five-minute grid."""
    return START + timedelta(minutes=5 * i)


def make_panel(spark, series: dict, schema: str = PANEL):
    """A panel from ``{unique_id: [y, ...]}`` on the five-minute grid."""
    rows = [(uid, at(i), float(y)) for uid, ys in series.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, schema)


def rows(frame, *order):
    """Rows as plain tuples, sorted."""
    frame = frame.select(*order) if order else frame
    plain = (tuple(r) for r in frame.collect())
    return sorted(plain, key=lambda r: [(v is None, v) for v in r])
