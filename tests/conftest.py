import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import skewed  # noqa: E402
from eddyline.session import checkpoint_dir, local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    """The test tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        spark.createDataFrame([], spark.read.parquet(str(path)).schema).write.parquet(str(folder / path.name))
    return str(folder)


@pytest.fixture(scope="session")
def skewed_tables(tmp_path_factory):
    return skewed.write("/root/testdata/sf0.001", tmp_path_factory.mktemp("skewed"))


def at(text: str, day: str = "2024-01-01") -> dt.datetime:
    """A UTC time of the day, as 10:05 or 10:05:30."""
    return dt.datetime.fromisoformat(f"{day}T{text if text.count(':') == 2 else text + ':00'}").replace(tzinfo=dt.UTC)
