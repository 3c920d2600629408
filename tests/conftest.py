import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tandem.session import checkpoint_root, local_session

    s = local_session(cores=4, shuffle_partitions=8, app="tandem-tests")
    checkpoint_root(s)  # sets a scratch folder only if the session names none
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (for order-insensitive comparisons)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
