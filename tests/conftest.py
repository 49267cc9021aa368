import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bidmatrix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ITEM = (
    "session_id string, quote_id string, vendor_name string, source_filename string, service_category string, "
    "sub_service string, description string, rate_cents bigint, amount_cents bigint"
)


@pytest.fixture
def frame(spark):
    """Joined line items from short tuples: (session, vendor, category, sub, amount[, rate, description])."""

    def build(rows):
        full = []
        for session, vendor, category, sub, amount, *rest in rows:
            rate = rest[0] if rest else amount
            text = rest[1] if len(rest) > 1 else None
            file = None if vendor is None else f"{vendor}.pdf"
            full.append((session, f"{session}/{vendor}", vendor, file, category, sub, text, rate, amount))
        return spark.createDataFrame(full, ITEM)

    return build


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
