"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    from statuta.session import build_session

    session = build_session("local[4]", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build
