import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from matchbook.session import ship

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


SCHEMA = "ord long, key string, frame string, vehicle_id long, camera_id int, emb array<double>"


@pytest.fixture(scope="session")
def rows(spark):
    """Observations from arrays; every row is its own frame unless frames are given."""

    def make(emb, vehicles=None, cameras=None, frames=None, start=0):
        n = len(emb)
        data = []
        for i in range(n):
            frame = frames[i] if frames is not None else f"f{start + i}"
            data.append((start + i, f"{frame}#{i}", frame, int(vehicles[i]) if vehicles is not None else 0,
                         int(cameras[i]) if cameras is not None else 0, [float(x) for x in emb[i]]))
        return spark.createDataFrame(data, SCHEMA)

    return make
