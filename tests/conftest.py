import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docquarry.session import local_session
    s = local_session("8", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
