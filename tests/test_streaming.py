from datetime import datetime

from tarnlake.functions.predicates import Op, cmp, col, const_int
from tarnlake.streaming.tail import committed_inserts, filter_stream, follow

SCHEMA = "txn_id long, type int, table_name string, ts timestamp"


def test_follow_a_log(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, 1, "", at), (1, 2, "a", at), (1, 3, "", at), (2, 2, "a", at)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "log"))
    stream = follow(spark, str(tmp_path / "log"), SCHEMA)
    for name, out, want in (("ins", committed_inserts(stream), [1]), ("fil", filter_stream(stream, cmp(col(1), Op.EQ, const_int(2))), [1, 2])):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.txn_id for r in spark.table(name).collect()) == want
