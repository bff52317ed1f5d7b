import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskloom.functions.findings import FILES_SCHEMA  # noqa: E402
from riskloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """``(repo_id, path, content)`` or ``(..., size, is_symlink)`` tuples as files."""

    def make(*rows):
        out = []
        for repo_id, path, content, *rest in rows:
            if isinstance(content, str):
                content = content.encode()
            size, link = rest if rest else (len(content or b""), False)
            out.append((repo_id, path, size, link, content))
        return spark.createDataFrame(out, FILES_SCHEMA)

    return make
