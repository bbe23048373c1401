import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for path in (ROOT, ROOT / "tests"):
    if str(path) not in sys.path:
        sys.path.insert(0, str(path))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxlake.session import local_session

    session = local_session(
        "tests", cores=8, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("shared"))
    )
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    from voxlake.sources.tables import Store

    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate `build(column)` over a list of values."""
    from pyspark.sql import functions as F

    def run(build, inputs, kind="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        return [r["v"] for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]

    return run
