import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from mercalith.session import get_session  # noqa: E402
from mercalith.spec import TARGET_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build a target from {row_id: {column: value}}; columns not named are NULL."""

    def build(rows: dict[int, dict], text: tuple[str, ...] = ()):
        names = [f.name for f in TARGET_SCHEMA]
        kinds = {f.name: f.dataType.simpleString() for f in TARGET_SCHEMA}
        schema = "row_id bigint, " + ", ".join(
            f"{n} {'string' if n in text else kinds[n]}" for n in names
        )
        data = [(i, *[values.get(n) for n in names]) for i, values in rows.items()]
        return spark.createDataFrame(data, schema)

    return build


def ids(df) -> set[int]:
    return {r.row_id for r in df.select("row_id").collect()}
