"""Committed versions: killed writes, two writers, readers of an older version."""

import threading

import pytest

from wayfare.sources import schemas, versions


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_versions_and_layouts(spark, tmp_path):
    base, built = f"file://{tmp_path}/cache", []

    def build(*v):
        built.append(v)
        return {"a": frame(spark, *v), "b": frame(spark, *v, *v)}

    first = versions.kept(spark, base, "1", lambda: build(1))
    assert values(first["a"]) == [1] and values(versions.kept(spark, base, "1", lambda: build(2))["b"]) == [1, 1]
    forced = versions.kept(spark, base, "1", lambda: build(3), force=True)
    assert values(forced["a"]) == [3] and values(first["a"]) == [1]  # an older version can still be read
    assert values(versions.kept(spark, base, "2", lambda: build(4))["a"]) == [4] and built == [(1,), (3,), (4,)]
    assert versions.numbers(spark, base) == [1, 2, 3]


def test_killed_write_leaves_the_old_version(spark, tmp_path):
    base = f"file://{tmp_path}/cache"
    versions.kept(spark, base, "1", lambda: {"a": frame(spark, 1), "b": frame(spark, 1)})

    def dies():
        bad = frame(spark, 9).selectExpr("raise_error('killed') as v")
        return {"a": frame(spark, 9), "b": bad}

    with pytest.raises(Exception, match="killed"):
        versions.kept(spark, base, "1", dies, force=True)
    now = versions.kept(spark, base, "1", dies)
    assert values(now["a"]) == [1] and values(now["b"]) == [1] and versions.numbers(spark, base) == [1]


def test_second_builder_takes_the_first_ones_version(spark, tmp_path):
    base = f"file://{tmp_path}/cache"

    def slow():
        versions.kept(spark, base, "1", lambda: {"a": frame(spark, 1)})  # another writer commits meanwhile
        return {"a": frame(spark, 2)}

    assert values(versions.kept(spark, base, "1", slow)["a"]) == [1]
    assert values(versions.kept(spark, base, "1", lambda: {"a": frame(spark, 3)}, force=True)["a"]) == [3]


def test_log_with_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"

    def write(k):
        for j in range(3):
            schemas.append_log(spark, path, frame(spark, 10 * k + j), f"t{k}")

    writers = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    frame(spark, 99).write.parquet(f"{path}/data/run=lost")  # written, never committed
    rows = versions.appended(spark, path).orderBy("run_order").collect()
    assert [r.run_order for r in rows] == [1, 2, 3, 4, 5, 6] and {r.v for r in rows} == {10, 11, 12, 20, 21, 22}
    for k in (1, 2):
        assert [r.v for r in rows if r.stamp == f"t{k}"] == [10 * k, 10 * k + 1, 10 * k + 2]


def test_a_number_is_given_once(spark, tmp_path):
    base = f"file://{tmp_path}/x"
    won = []
    writers = [threading.Thread(target=lambda k=k: won.append((k, versions.publish(spark, base, 1, f"w{k}")))) for k in range(8)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    winners = [k for k, ok in won if ok]
    assert len(winners) == 1 and versions.content(spark, base, 1) == f"w{winners[0]}"
