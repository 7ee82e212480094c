import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockline.session import build_session  # noqa: E402
from stockline.tables import SCHEMAS, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", shuffle_partitions=3,
        **{"spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="stockline-tests-"),
           "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """``make("orders", {...}, {...})`` builds a table; fields left out are NULL."""

    def build(name, *rows):
        ddl = SCHEMAS.get(name, name)
        names = [c.split()[0] for c in _split(ddl)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    return build


@pytest.fixture(scope="session")
def tables(make):
    """A bundle with the given tables' rows; all other tables are empty."""

    def build(**rows):
        return Tables({n: (lambda n=n: make(n, *rows.get(n, ()))) for n in SCHEMAS})

    return build


def _split(ddl):
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch in "(<") - (ch in ")>")
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out + [ddl[start:].strip()]
