import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("gleanframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# One day at twelve piers: every column is there for one thing the profile has to tell apart.
PROBE_COLUMNS = [
    ("sonar_depth_cm", "double"), ("sonar_depth_mm", "double"), ("sky", "string"), ("pier", "string"), ("tide", "string"), ("salinity", "double"),
    ("berths", "int"), ("cargo", "string"), ("remark", "string"), ("signal", "string"), ("log_entry", "string"), ("unused", "double"),
]
PROBE_ROWS = [
    (4.0, 4.25, "clear", "north", "in", 31.0, 3, "grain", None, None, None, None),
    (6.5, 6.0, "cloudy", "mole", "out", 32.5, 5, None, "late", None, None, None),
    (5.5, 5.5, "clear", "quay", "in", None, 3, "timber", None, "red", "#", None),
    (7.0, 7.5, "rain", "north", "in", 33.0, None, "grain", None, None, None, None),
    (90.0, 88.0, "rain", "jetty", "out", 30.5, 7, None, "damaged", None, "12/31", None),
    (3.5, 3.0, "clear", "mole", "in", 34.0, None, "grain", None, "green", None, None),
    (8.0, 8.25, "cloudy", "north", "out", 60.0, 4, None, None, None, None, None),
    (6.0, 6.25, "clear", "ferry", "in", 31.5, None, "fish", "late", "red", "17", None),
    (5.0, 4.75, "cloudy", "quay", "out", None, None, "timber", None, None, None, None),
    (45.0, 41.0, "clear", "north", "in", 32.0, None, None, "late", None, None, None),
    (7.5, 7.75, "rain", "slip", "out", 33.5, None, None, None, None, "wind NE", None),
    (4.5, 4.5, "clear", "mole", "in", 32.25, 6, "fish", None, None, None, None),
]
PROBE_SCHEMA = "row int, " + ", ".join(f"{n} {t}" for n, t in PROBE_COLUMNS)
PROBE_NAMES = [n for n, _ in PROBE_COLUMNS]


@pytest.fixture(scope="session")
def probe(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(PROBE_ROWS)], PROBE_SCHEMA)


@pytest.fixture(scope="session")
def probe_profile(probe):
    from gleanframe.operators.profile import profile

    return profile(probe, columns=PROBE_NAMES)
