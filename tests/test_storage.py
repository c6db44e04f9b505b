from types import SimpleNamespace

import pytest

from millrace.plans.storage import clear_scratch, materialise, scratch_path, shared_dir


def test_scratch_is_written_below_the_shared_folder(spark):
    base = shared_dir(spark)
    assert scratch_path(spark, "x").startswith(f"{base}/millrace/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = materialise(spark.range(5), "t")
    assert df.count() == 5
    assert f"{base}/millrace/t-".split(":")[-1] in df.inputFiles()[0]


def test_the_session_names_the_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "hdfs:///shared/"}.get(key, default)))
    assert shared_dir(session) == "hdfs:///shared"


def test_clearing(spark):
    df = materialise(spark.range(1), "t")
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        df.count()
