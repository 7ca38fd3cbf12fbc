import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from gridmark.session import get_session

    s = get_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def mask(spark):
    """Builds a mask table from text art: '#' is foreground."""
    def build(art, image_id=1):
        rows = art.strip().split()
        h, w = len(rows), len(rows[0])
        px = [(image_id, h, w, y, x) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"]
        return spark.createDataFrame(px, "image_id long, height int, width int, y int, x int")
    return build
