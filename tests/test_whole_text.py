"""Tag parsing over whole, awkward texts."""

import duckdb
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.plans import catalogue

TEXTS = [
    "é" * 5000 + " 12.5 [12.5][S02]not a tag[13] end", "a\nb [3] c", " [", "[\\7] [\\\\8] \\[9", "對 [S01] [x] 1, 2!", "x" * 41, "", "\t line  ", "ends in [1",
]


def test_escaping_reads_back(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", tx.escape_tags(F.col("t")).alias("e")).select("t", tx.unescape_tags(F.col("e")).alias("back"), F.col("e").rlike(r"\[[0-9]").alias("tag")).collect()
    assert all(r.back == r.t and not r.tag for r in rows)


def test_whole_turns_are_parsed(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(c, k, ("user", "assistant", "tool")[k % 3], t) for c in (0, 1, 9) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
    columns = "recording_id, part, seg_ord, start_ms, end_ms, speaker, text"
    want = con.execute(f"select {columns} from ({catalogue.oracle_sql()['segment_shift_parse_whole']})").fetchall()
    got = [tuple(r) for r in catalogue.queries()["segment_shift_parse_whole"](spark, folder).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)
    assert max(len(r[-1]) for r in got) > 5000
