"""The entry point without optional parts, and sources that need modules which may be absent."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from framelake import schemas
from framelake.registry.derived import alerts
from framelake.sources.tables import scan_alerts

ROOT = Path(__file__).resolve().parents[1]
ASK = """
import sys
for name in {blocked}:
    sys.modules[name] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(len(e.queries()), sum(n.startswith("op") and n[2].isdigit() for n in e.queries()), "pipeline" in e.queries(),
      set(e.oracle_sql()) <= set(e.queries()))
"""


def asked(blocked):
    done = subprocess.run([sys.executable, "-c", ASK.format(blocked=blocked, root=str(ROOT))], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("blocked", [["zstandard"], ["xxhash"], ["framelake.llm"]])
def test_core_queries_without_an_optional_module(blocked):
    from framelake import registry

    assert asked(blocked) == [str(len(registry.QUERIES)), "0", "False", "True"]


def test_alerts_in_avro(spark, sf, tmp_path):
    """The same packets from Avro as from Parquet, where Spark has its Avro module."""
    rows = alerts(spark, sf)
    rows.write.parquet(f"{tmp_path}/parquet")
    try:
        rows.write.format("avro").save(f"{tmp_path}/avro")
    except AnalysisException as error:
        pytest.skip(f"Spark's Avro module is not on the classpath: {error.getCondition()}")
    found, expected = scan_alerts(spark, f"{tmp_path}/avro", "avro"), scan_alerts(spark, f"{tmp_path}/parquet")
    assert found.schema == schemas.ALERTS and found.count() == expected.count()
    assert found.exceptAll(expected).isEmpty()
