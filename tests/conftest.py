import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quaylight.session import checkpoint_dir, local_session, use_utc  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = use_utc(local_session(4, **{"spark.sql.shuffle.partitions": "4"}))
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    checkpoint_dir(session)
    yield session
    session.stop()
