import sys

import pytest

from fixture_paths import ROOT

sys.path.insert(0, ROOT)

from graphssl.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    ensure_checkpoint_dir(s)     # tests only: a scratch folder when none is configured
    yield s
    s.stop()
