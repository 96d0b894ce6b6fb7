import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from atlasmill.runtime import configure
    yield configure(session)
    session.stop()


@pytest.fixture
def image(spark):
    """Build pixel rows from a picture drawn with characters."""

    def build(pictures, colors):
        rows = [(i, x, y, *colors[ch]) for i, lines in enumerate(pictures)
                for y, line in enumerate(lines) for x, ch in enumerate(line)]
        return spark.createDataFrame(rows, "image_id BIGINT, x INT, y INT, r INT, g INT, b INT, a INT")
    return build


def pixels(df):
    """``{(image, x, y): (r, g, b, a)}`` of a small frame."""
    return {(p.image_id, p.x, p.y): (p.r, p.g, p.b, p.a) for p in df.collect()}
