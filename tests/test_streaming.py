"""Freshness as state, and requests that are asked once."""

import datetime as dt
import json
import os

from ledgerine.operators import store
from ledgerine.streaming import freshness, requests

T0 = dt.datetime(2024, 1, 1)


def test_identifiers_go_stale(spark, tmp_path):
    schema = "id string, updated_at timestamp"

    def run(*rows):
        spark.createDataFrame([(i, None if d is None else T0 + d) for i, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = freshness.gone_stale(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["id"], (r["updated_at"] - T0).days) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())

    day = dt.timedelta(days=1)
    assert run(("a", 0 * day), ("b", 1 * day), ("a", -3 * day), ("n", None)) == []
    assert run(("c", 30 * day)) == []  # a is exactly 30 days old
    assert run(("c", 30 * day + dt.timedelta(milliseconds=1))) == [("a", 0)]
    assert run(("b", 31 * day), ("a", 31 * day)) == [("a", 0)]  # updates in time, and a new beginning
    assert run(("z", 61 * day + dt.timedelta(seconds=1))) == [("a", 0), ("a", 31), ("b", 31), ("c", 30)]


def test_nothing_is_asked_twice(spark, tmp_path):
    s, noted = store.Store(spark, f"{tmp_path}/kept"), f"{tmp_path}/asked"
    os.makedirs(f"{tmp_path}/in")

    def get(url, timeout):
        with open(noted, "a") as f:
            f.write(f"{url}\n")
        if url.startswith("bad"):
            raise OSError("gone")
        return url.encode()

    def run(*urls, **more):
        if urls:
            with open(f"{tmp_path}/in/{len(os.listdir(f'{tmp_path}/in'))}.json", "w") as f:
                f.write("".join(json.dumps({"url": u}) + "\n" for u in urls))
        requests.answer(spark, f"{tmp_path}/in", s, f"{tmp_path}/cp", get, rate=1000.0, tasks=2, **more).awaitTermination()
        return sorted(open(noted).read().split())

    assert run("a", "b", "a", None, "bad1") == ["a", "b", "bad1"]
    assert run("b", "c") == ["a", "b", "bad1", "c"]
    for name in [n for n in os.listdir(f"{tmp_path}/cp/commits") if n.lstrip(".").startswith("1")]:  # as if the stream died before it noted the last batch
        os.remove(f"{tmp_path}/cp/commits/{name}")
    assert run() == ["a", "b", "bad1", "c"]
    assert run("bad1", "a") == ["a", "b", "bad1", "c"] and run("bad1", "a", retry=True) == ["a", "b", "bad1", "bad1", "c"]
    assert sorted((r["url"], r["content"] and bytes(r["content"]), r["error"]) for r in s.read("answers").collect()) == [("a", b"a", None), ("b", b"b", None), ("bad1", None, "OSError: gone"), ("c", b"c", None)]
