import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ventana.session import build_session, checkpoint_dir
    s = build_session("local[*]", app_name="ventana-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ventana-tests-")})
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Collected rows as tuples (optionally only some columns)."""
    d = df.select(*cols) if cols else df
    return [tuple(r) for r in d.collect()]
