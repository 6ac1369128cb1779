import re

import pyarrow as pa

from quadrille.llm.common import map_slices


def test_freed_memory_is_given_back_between_slices(spark):
    pinned = []

    def used():
        return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

    def run(piece):
        before = used()
        if not pinned:
            held = [bytes(2000) for _ in range(100_000)]  # 200 MB in small pieces
            pinned.append(held[-1])  # keeps the heap from shrinking by itself
            before = used()
        return pa.RecordBatch.from_arrays([pa.array([before], pa.int64())], names=["mb"])

    df = spark.createDataFrame([("a" * 10,), ("b" * 10,)], "text string").coalesce(1)
    first, second = [r.mb for r in map_slices(df, 0, "mb long", run, slice_bytes=1).collect()]
    assert first - second > 100, (first, second)
