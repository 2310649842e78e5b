from types import SimpleNamespace

import pytest

from auditloom.session import materialise, scratch_root


def fake(master, root=None, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: root), sparkContext=context)


def test_scratch_folder_comes_from_the_session():
    assert scratch_root(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_root(fake("yarn", None, "s3a://b/c")) == "s3a://b/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(fake("yarn"))
    assert scratch_root(fake("local[2]")) == scratch_root(fake("local[2]"))


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(id, id + 1) AS pair")
    back = materialise(df, "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.columns == df.columns
