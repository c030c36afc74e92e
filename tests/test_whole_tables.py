"""Queries on tables whose ids lie beyond those of the small test tables."""

from skeinlake.plans import catalogue


def test_sessions_of_any_id_are_counted(spark, tmp_path):
    rows = [(c, t, "assistant" if t else "user", "x") for c, n in ((5, 2), (119, 1), (120, 3), (5000, 4)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["session_id"]: r["message_count"] for r in catalogue.QUERIES["session_message_count"](spark, str(tmp_path)).collect()}
    assert got == {5: 1, 119: 0, 120: 2, 5000: 3}


def test_quota_is_filled_from_parts_of_any_id(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (70, 70, 80)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (2, 4, *range(60, 90))], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["quota_topup_fill"](spark, str(tmp_path)).select("k", "source").collect()]
    assert got == [(70, 0), (80, 0), (2, 1), (4, 1), *((k, 2) for k in range(60, 66))]
