import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def boxes(spark):
    def make(*sides, sample="a"):
        lx, ly, lz = (*sides, None, None)[:3]
        return spark.createDataFrame([(sample, 3 if lz else 2, float(lx), float(ly), float(lz) if lz else None, True, "9")],
                                     "sample_id string, dim int, lx double, ly double, lz double, periodic boolean, matrix_phase string")
    return make


@pytest.fixture
def disks(spark):
    def make(rows, sample="a"):
        return spark.createDataFrame([(sample, k, "2", "Disk", float(x), float(y), float(r)) for k, (x, y, r) in enumerate(rows)],
                                     "sample_id string, particle_id bigint, phase string, shape string, cx double, cy double, r double")
    return make
