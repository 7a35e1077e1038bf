import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from formgrain import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "formgrain-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


OCR_SCHEMA = (
    "doc_id string, plugin string, text string, "
    "lines array<struct<box:array<array<double>>,text:string,score:double>>"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(rows):
        """rows: (doc_id, plugin, lines or text); a line is text, (text, score) or (text, score, box)."""
        data = []
        for doc_id, plugin, body in rows:
            if isinstance(body, str) or body is None:
                data.append((doc_id, plugin, body, None))
                continue
            lines = []
            for line in body:
                line = line if isinstance(line, tuple) else (line,)
                text, score, box = (*line, None, None)[:3]
                box = [[float(v) for v in p] for p in box] if box else None
                lines.append((box, text, score))
            data.append((doc_id, plugin, None, lines))
        return spark.createDataFrame(data, OCR_SCHEMA)

    return build
