import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    # workers import the package by this path, wherever the tests are started
    os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    from trackspark.session import local_session
    session = local_session("tests", cpus=8)
    session.conf.set("spark.sql.shuffle.partitions", "8")
    return session


@pytest.fixture
def documents(spark):
    """documents(texts): ids in order, with extra columns whose names clash with internal ones."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", 0 if t is None else len(t), 1.0, "x", 7)
                for i, t in zip(ids, texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, score double, items string, row int")
    return make
