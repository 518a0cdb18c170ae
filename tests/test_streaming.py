import pytest

from conftest import PROBE_NAMES
from gleanframe import curated, fit_rules, outlier_verdicts, with_verdicts
from gleanframe.streaming.apply import curate_stream, flag_stream


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, probe, probe_profile, tmp_path):
    probe.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = fit_rules(probe, probe_profile, "iqr")
    facts = with_verdicts(probe_profile, outlier_verdicts(probe, probe_profile, "iqr"))
    source = spark.readStream.schema(probe.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(curate_stream(source, facts, rules), "curated_stream")
    want = curated(probe, facts, rules, ["row"])
    assert {r["row"]: r.asDict() for r in got.collect()} == {r["row"]: r.asDict() for r in want.collect()}
    cells = drain(flag_stream(source, facts, rules, ["row"]), "cell_stream")
    assert cells.filter("status = 'outlier'").count() == 5 and set(cells.columns) == {"row", "feature", "value", "status"}
    assert "salinity" in PROBE_NAMES
    with pytest.raises(ValueError):
        curate_stream(source, facts, rules, "random")
