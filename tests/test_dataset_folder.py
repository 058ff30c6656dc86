import pytest

from quillmere.sources.dataset_folder import read_groups, split_groups, write_groups


def test_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    rows = spark.createDataFrame([(1.5, 2, 0.1, "a"), (2.5, 3, 0.2, "b"), (3.5, 4, 0.3, "b")], "u double, v int, y double, g string")
    write_groups(rows, folder, "g", ["u", "v"], "y")
    assert sorted(map(tuple, read_groups(spark, folder).collect())) == sorted((u, v, y, g) for u, v, y, g in rows.collect())
    write_groups(rows.where("g = 'b'").withColumn("u", rows.u * 10).limit(1), folder, "g", ["u", "v"], "y")
    got = read_groups(spark, folder)
    assert got.where("g = 'a'").count() == 1 and [r.u for r in got.where("g = 'b'").collect()] == [25.0]
    with pytest.raises(ValueError):
        write_groups(rows, folder, "g", ["u"], "y")
    with pytest.raises(FileNotFoundError):
        read_groups(spark, f"file://{tmp_path}/none")


def test_whole_groups(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 50 as string) as g")
    train, test = split_groups(df, "g", 0.3, 7)
    assert train.count() + test.count() == 500 and 0 < test.count() < 300
    assert train.select("g").intersect(test.select("g")).count() == 0
    with pytest.raises(ValueError):
        split_groups(df, "g", 2)
