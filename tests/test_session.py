from types import SimpleNamespace

import pytest

from strandloom.session import ensure_checkpoint_dir, partitions_for, planned_bytes


def test_partitions_follow_the_tables_read(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "repeat(cast(id as string), 9) as text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id > 5").select("id")
    size, least = planned_bytes(df), partitions_for(spark)
    assert size > 100_000 and partitions_for(spark, df, each=size) == least
    assert partitions_for(spark, df, each=size // 50) >= 50 and partitions_for(spark, df, each=size // 50, most=20) == max(20, least)
    assert planned_bytes(spark.range(10).select("id")) < 10_000


def test_no_local_checkpoint_folder_off_one_machine():
    made = []
    session = lambda master, folder=None: SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    )
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master))
    ensure_checkpoint_dir(session("yarn", "hdfs:///shared"))
    ensure_checkpoint_dir(session("local[4]"))
    assert made[0] == "hdfs:///shared" and len(made) == 2
