import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BLOCKS = "doc string, page int, ord int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, font double, bold boolean, page_w double, page_h double"


@pytest.fixture
def blocks(spark):
    def make(rows, width=600.0, height=800.0):
        """rows: page, ord, text, x0, y0, x1, y1, font."""
        return spark.createDataFrame([("d", p, o, f"p{p:04d}-b{o + 1:04d}", t, *map(float, box), False, width, height) for p, o, t, *box in rows], BLOCKS)

    return make
