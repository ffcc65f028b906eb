import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("balsam-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from balsam.session import ship_package
    ship_package(s)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="balsam-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def events_fixture(spark):
    """Inline fixture I: the domain rules of the reference's event table."""
    rows = [
        ("e01", "2020-01-05", "Taliban", "Attack", None, None, "Tehrik-i-Taliban fighters", 1),
        ("e02", "2020-01-05", "Taliban - Red Unit", "Armed clash", None, "", "Talibanized", 0),
        ("e03", "2020-01-06", "Mutiny of Taliban", "Sexual violence", None, "NA", None, 2),
        ("e04", "2020-01-07", "Islamic State Khorasan Province (ISKP)", "Suicide bomb",
         "local administrators", "civilians", "Islamic State Khorasan Province (ISKP)", 5),
        ("e05", "2020-01-08", "Unidentified Armed Group (Afghanistan)", None,
         "local administrators; women targeted: politicians", None, "", 0),
        ("e06", "2020-01-09", "Taliban and/or Islamic State Khorasan Province (ISKP)", "Grenade",
         "women targeted: girls; extra", None, "near Dawlat Shah Wali Kot today", 3),
        ("e07", "2020-01-10", "Al Qaeda", "Attack", "women targeted: girls", None, "x", 0),
        ("e08", "2020-01-11", None, "Attack", None, None, "a b\t c  d", 0),
        ("e09", "2020-01-12", "Taliban", None, "women targeted: girls", None, "éTaliban", 1),
    ]
    schema = ("row_id string, event_date string, actor1 string, sub_event_type string, tags string, "
              "civilian_targeting string, notes string, fatalities int")
    return spark.createDataFrame(rows, schema)
