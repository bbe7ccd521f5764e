import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from samples import passage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from proofmill.session import build_session
    s = build_session("tests", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def records(spark):
    """Intake records with nulls, empties, copies, long and odd texts, and columns whose names clash with the operators' own."""
    base = passage(60)
    near = base.split()
    near[30] = "changed"
    long = passage(20_000, 5, 3)
    rows = [
        (1, base, "en", "upload"), (2, base, "en", "upload"), (3, " ".join(near), "en", None), (4, None, None, None), (5, "", "en", "upload"),
        (6, "  \t\n ", "de", "mail"), (7, "One", "de", "mail"), (7, "One", "de", "mail"), (None, base + " tail", "en", "upload"), (None, None, None, None),
        (8, long, "en", "upload"), (9, "ÄÖ İstanbul \U0001F600 " + passage(30, 9), "fr", "mail"), (10, passage(45, 3, 2), "fr", "mail"), (11, passage(45, 3, 2), "fr", "mail"),
        (12, "a\n" * 30 + passage(40, 8), "en", "upload"),
    ]
    df = spark.createDataFrame(rows, "evidence_id long, intake_notes string, language string, source_platform string")
    for c in ("id", "text", "n", "key", "spans", "words", "kept", "k1", "node", "weight", "topic"):
        df = df.withColumn(c, df["language"])
    return df


@pytest.fixture(scope="session")
def empty(records):
    return records.limit(0)
