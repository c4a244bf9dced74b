from __future__ import annotations

from ranklane.operators import encode, profiles
from ranklane.streaming import positions

SCHEMA = "cell bigint, state string, ids array<bigint>"


def test_a_stream_of_lists_sums_like_one_table(spark, tmp_path):
    parts = [[(1, "a", [10, 11, 12]), (2, "a", [11, 10])], [(3, "a", [10]), (4, "b", [12, 10])]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        positions.keep_sums(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    got = sorted(map(tuple, positions.latest(spark, f"file://{tmp_path}/out").collect()))
    every = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = sorted(map(tuple, profiles.position_sums(positions.lists_to_rows(every), "state").collect()))
    assert got == want
    assert encode.from_lists(every).count() == len(positions.lists_to_rows(every).collect())
