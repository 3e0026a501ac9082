"""Blocks of a large group: each left row meets each row once, in whatever block."""

from collections import Counter

import pyarrow as pa

from sondera.llm import neardup


def test_every_left_row_meets_every_row_once(spark):
    members = [(1, b) for b in range(50)] + [(2, b) for b in range(100, 103)] + [(3, b) for b in range(200, 240)]
    rows = spark.createDataFrame(members, "a long, b long")
    left = rows.where("(a = 1 and b % 3 = 0) or (a = 2 and b = 101)")  # none of group 3

    def meet(table: pa.Table) -> pa.Table:
        role, b = table.column("role").to_pylist(), table.column("b").to_pylist()
        firsts, seconds = ([x for x, r in zip(b, role, strict=True) if r == k] for k in (0, 1))
        pairs = [(x, y) for x in firsts for y in seconds]
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    met = Counter((r.a, r.b) for r in neardup.in_blocks(rows, "a", left, meet, block=8).collect())
    want = [(x, y) for g, x in members for h, y in members if g == h and ((g == 1 and x % 3 == 0) or (g == 2 and x == 101))]
    assert met == Counter(want)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "a long, b long")
    assert neardup.in_blocks(rows, "a", rows, lambda t: t.select(["a", "b"]), block=8).collect() == []
