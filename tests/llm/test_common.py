from types import SimpleNamespace

import pytest

from blockloom.llm import common


def test_no_local_folder_off_local_mode():
    for master, fine in (("local[4]", True), ("local", True), ("local[*, 2]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)):
        made = []
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append))
        if fine:
            assert common.shared_dir(spark) == made[0].rstrip("/")
        else:
            with pytest.raises(RuntimeError, match="checkpoint.dir"):
                common.shared_dir(spark)


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with common.scratch() as outer:
        with common.scratch() as keep:
            gone, kept = common.stored(spark.range(5).toDF("a"), "gone"), keep(common.stored(spark.range(7).toDF("a"), "kept"))
        assert kept.count() == 7
        with pytest.raises(Exception):
            spark.read.parquet(gone._stored_at).count()
        last = outer(common.stored(kept.where("a > 2"), "last"))
    assert last.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(kept._stored_at).count()
    with pytest.raises(ValueError), common.scratch():
        gone = common.stored(spark.range(2).toDF("a"), "gone")
        raise ValueError
    with pytest.raises(Exception):
        spark.read.parquet(gone._stored_at).count()


def test_set_aside_gives_names_back(spark):
    docs = spark.createDataFrame([(1, "t", 2, 3)], "doc_id long, text string, `a.b` int, _row int")
    aside = common.set_aside(docs, "text")
    assert aside.columns == ["__0", "text", "__2", "__3"] and aside.toDF(*docs.columns).columns == docs.columns
