"""Round trips of files."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.sources import binary, files


def test_token_shards(spark, tmp_path):
    spark.dataSource.register(binary.ShardSource)
    rows = spark.range(1000).select(F.when(F.col("id") < 400, "val").otherwise("train").alias("split"), F.floor(F.col("id") / 400).alias("shard_idx"), (F.col("id") % 400).alias("token_index"), (F.col("id") * 61 % 65536).cast("double").alias("value"))
    rows.repartition(3, "split", "shard_idx").write.format("shards").mode("append").save(str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["train_000001.bin", "train_000002.bin", "val_000000.bin"]
    assert np.fromfile(tmp_path / "t/val_000000.bin", "<u2").tolist() == [i * 61 % 65536 for i in range(400)]
    back = spark.read.format("shards").load(str(tmp_path / "t"))
    assert back.count() == 1000 and back.exceptAll(rows).count() == 0
    assert spark.read.format("shards").option("split", "val").load(str(tmp_path / "t")).count() == 400


def test_losses(spark, tmp_path):
    spark.dataSource.register(binary.ShardSource)
    rows = spark.createDataFrame([("val", 0, 1, 1.5), ("val", 0, 2, None), ("val", 0, 3, 2.5)], "split string, shard_idx long, token_index long, value double")
    rows.coalesce(1).write.format("shards").option("dtype", "f2").mode("append").save(str(tmp_path / "l"))
    got = [r.value for r in spark.read.format("shards").option("losses", "true").load(str(tmp_path / "l")).orderBy("token_index").collect()]
    assert got == [None, 1.5, None, 2.5]
    assert binary.source_name(binary.loss_name("val_000000.bin")) == "val_000000.bin"


def test_odd_size(tmp_path):
    (tmp_path / "val_000000.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        binary.discover(str(tmp_path))


def test_json_sources(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"p": "1"}\n\n{"p": "2"}\n')
    (tmp_path / "a.jsonl").write_text('{"p": "0"}\n')
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.jsonl", "a.jsonl")
        z.write(tmp_path / "b.jsonl", "b.jsonl")
    for df in (files.json_folder(spark, str(tmp_path), "p string"), files.json_archive(spark, str(tmp_path / "z.zip"), "p string")):
        assert [r.p for r in df.orderBy("file", "line").collect()] == ["0", "1", "2"]
    assert files.first_source([None, str(tmp_path / "no"), str(tmp_path)])[0] == str(tmp_path)


def test_small_files(spark, tmp_path):
    assert files.read_meta(str(tmp_path / "none.json")) == {}
    files.write_json(str(tmp_path / "m.json"), {"a": (1, 2)})
    assert files.read_meta(str(tmp_path / "m.json")) == {"a": [1, 2]}
    files.write_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "c"))
    assert any("a,b" in p.read_text() for p in (tmp_path / "c").glob("part*"))


def test_trimming(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([('{"step": 1}',), ("odd line",), ('{"step": 9}',)], "value string").coalesce(1).write.text(folder)
    assert files.trim_run(spark, [folder], 5) == {"removed": 1, "kept": 2, "invalid_lines_kept": 1}
    assert sorted(r.value for r in spark.read.text(folder).collect()) == ["odd line", '{"step": 1}']
    assert spark.read.text(f"{folder}.backup").count() == 3
    assert files.trim_run(spark, [folder], 5)["removed"] == 0
    lists = str(tmp_path / "steps.json")
    (tmp_path / "steps.json").write_text('[{"step": 1}, {"step": 9}]')
    spark.createDataFrame([('{"step": 8}',), ('{"step": 2}',)], "value string").coalesce(1).write.text(f"{folder}-rank0")
    assert files.trim_run(spark, [folder], 5, lists=[lists], exposures=[f"{folder}-rank0"]) == {"removed": 2, "kept": 4, "invalid_lines_kept": 1}
    assert spark.read.text(lists).first().value == '[{"step":1}]'
    spark.createDataFrame([('{"step": 7}',)], "value string").coalesce(1).write.mode("append").text(folder)
    assert files.trim_run(spark, [folder], 5)["removed"] == 1 and spark.read.text(folder).count() == 2 and spark.read.text(f"{folder}.backup").count() == 3


def test_first_loaded(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "there"))
    df, place = files.first_loaded([None, str(tmp_path / "no"), str(tmp_path / "no"), str(tmp_path / "there")], spark.read.parquet)
    assert place == str(tmp_path / "there") and df.count() == 5
    with pytest.raises(FileNotFoundError, match="no source loads"):
        files.first_loaded([str(tmp_path / "no")], spark.read.parquet)


def test_shared_folder(spark, monkeypatch):
    """Without a shared folder a cluster is an error, one machine is not."""
    from loomstead.sources import shared

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, master):
            self.conf = Conf({"spark.master": master})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session("spark://host:7077"))
    assert shared.shared_dir(Session("local[4]")).startswith("file://")
