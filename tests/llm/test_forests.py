"""Reply trees with circles, repeated numbers and missing parents."""

from parlance.llm import chat


def paths(spark, rows, branches=1):
    forest = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string")
    got = chat.best_paths(forest, branches).orderBy("conv_id", "branch", "depth").collect()
    return [(r.conv_id, r.branch, r.depth, r.text) for r in got]


def test_circles_end_and_reach_no_root(spark):
    rows = [(1, 1, 2, "user", "a"), (1, 2, 1, "user", "b"), (1, 3, 2, "user", "hangs from it"), (1, 4, 4, "user", "itself"), (1, 5, None, "user", "root"), (1, 6, 5, "user", "leaf")]
    assert paths(spark, rows, 3) == [(1, 1, 1, "root"), (1, 1, 2, "leaf")]
    assert paths(spark, rows[:4]) == []


def test_repeated_numbers_count_once(spark):
    chain = [(1, n, n - 1 if n > 1 else None, "user", f"m{n}") for n in range(1, 5)]
    assert paths(spark, chain * 2 + [(1, 2, 1, "user", "z"), (1, None, 1, "user", "x" * 99)]) == [(1, 1, n, f"m{n}") for n in range(1, 5)]


def test_a_missing_parent_makes_a_root(spark):
    rows = [(1, 7, 99, "user", "no parent"), (1, 8, 7, "assistant", "b"), (None, 1, None, "user", "c")]
    assert paths(spark, rows) == [(None, 1, 1, "c"), (1, 1, 1, "no parent"), (1, 1, 2, "b")]


def test_a_long_thread(spark):
    rows = [(3, n, n - 1 if n else None, "user", str(n)) for n in range(300)]
    assert [x[2] for x in paths(spark, rows)] == list(range(1, 301))
