"""Schemas, catalog, transactions, the log and recovery, with the end-to-end scenarios."""

import shutil

import pytest
from pyspark.sql import functions as F

from tarnlake.plans import recovery
from tarnlake.schema import MAX_ROW_BYTES, Column, Schema, TypeId
from tarnlake.sources.catalog import Catalog, Rid
from tarnlake.sources.log import SCHEMA, LogManager, Record, RecordType, read_log, to_bytes
from tarnlake.sources.transactions import TransactionManager

ACCOUNTS = Schema([("id", TypeId.INTEGER), ("name", TypeId.VARCHAR)])


def stats(spark, log, tables=("accounts",)):
    return tuple(recovery.stats(log, [*tables]).first())


def test_schema():
    assert ACCOUNTS.index_of("name") == 1 and ACCOUNTS.index_of("NAME") == -1
    for row in ((1,), ("1", "a"), (1, 2), (True, "a"), (2**63, "a")):
        with pytest.raises(ValueError):
            ACCOUNTS.check(row)
    data = ACCOUNTS.encode((5, "né"))
    assert data == (5).to_bytes(8, "little") + (3).to_bytes(4, "little") + "né".encode()
    assert ACCOUNTS.decode(data + b"more") == (5, "né") and ACCOUNTS.decode_column(data, 1) == "né"
    with pytest.raises(ValueError):
        ACCOUNTS.decode(data[:-1])
    with pytest.raises(ValueError):
        ACCOUNTS.decode_column(data, 2)
    assert MAX_ROW_BYTES == 4076
    assert ACCOUNTS.fits((1, "x" * (4076 - 12))) and not ACCOUNTS.fits((1, "x" * (4077 - 12)))
    assert len(Schema([Column("a", TypeId.INTEGER)])) == 1


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("accounts", ACCOUNTS)
    with pytest.raises(ValueError):
        c.create_table("accounts", ACCOUNTS)
    assert c.get_table("none") is None and c.count_rows("none") == -1 and c.count_rows("accounts") == 0
    c.create_index("by_id", "accounts", "id")
    assert c.lookup("by_id", 1).count() == 0 and tuple(c.index_summary("by_id").first()) == (0, None, None)
    rids = c.insert_rows("accounts", [(1, "x"), (1, "y"), (2, "z" * 5000)])
    assert [c.fetch("accounts", r) for r in rids[:2]] == [(1, "x"), (1, "y")] and rids[0].place == 0 and rids[2] is None
    c.append("accounts", spark.range(3, 6, 1, 3).select("id", F.lit("bulk").alias("n")))
    assert [c.fetch("accounts", Rid(c.tables["accounts"].batches[-1], i)) for i in (0, 1, 2, 3)] == [(3, "bulk"), (4, "bulk"), (5, "bulk"), None]
    for bad in (("by_id", "accounts", "id"), ("i2", "none", "id"), ("i3", "accounts", "zz"), ("i4", "accounts", "name")):
        with pytest.raises(ValueError):
            c.create_index(*bad)
    assert [r.name for r in c.lookup("by_id", 1).collect()] == ["x"] and c.lookup("by_id", 99).count() == 0
    assert tuple(c.index_summary("by_id").first()) == (4, 1, 5)
    assert c.get_index("none") is None and c.get_index("by_id").key == 0
    again = Catalog(spark, str(tmp_path))
    again.create_table("accounts", ACCOUNTS)
    assert again.count_rows("accounts") == 5


def test_durability(spark, tmp_path):
    """100 rows, one commit, data lost: the log rebuilds them."""
    c, log = Catalog(spark, str(tmp_path / "data")), LogManager(spark, str(tmp_path / "log"))
    c.create_table("accounts", ACCOUNTS)
    m = TransactionManager(c, log)
    t = m.begin()
    assert all(m.insert(t, "accounts", (i, f"acct_{i}")) for i in range(1, 101))
    m.commit(t)
    assert c.count_rows("accounts") == 100 and log.flushed_lsn == 101
    shutil.rmtree(tmp_path / "data")
    again = Catalog(spark, str(tmp_path / "data"))
    again.create_table("accounts", ACCOUNTS)
    for _ in range(2):  # rebuilding twice changes nothing
        got, next_id = recovery.recover(again, LogManager(spark, str(tmp_path / "log")).records())
        assert tuple(got.first()) == (102, 1, 0, 100, 0) and next_id == 2
        assert [(r.id, r.name) for r in again.committed("accounts").orderBy("id").collect()] == [(i, f"acct_{i}") for i in range(1, 101)]


def test_atomicity(spark, tmp_path):
    """50 committed rows and 30 of a transaction that never ended."""
    c, log = Catalog(spark, str(tmp_path / "data")), LogManager(spark, str(tmp_path / "log"))
    c.create_table("accounts", ACCOUNTS)
    m = TransactionManager(c, log)
    good, dirty = m.begin(), None
    for i in range(1, 51):
        m.insert(good, "accounts", (i, f"good_{i}"))
    m.commit(good)
    dirty = m.begin()
    for i in range(51, 81):
        m.insert(dirty, "accounts", (i, f"dirty_{i}"))
    log.flush()
    assert c.count_rows("accounts") == 80 and c.committed("accounts").count() == 50
    again = Catalog(spark, str(tmp_path / "new"))
    again.create_table("accounts", ACCOUNTS)
    got, next_id = recovery.recover(again, LogManager(spark, str(tmp_path / "log")).records())
    assert tuple(got.first()) == (83, 1, 1, 50, 30) and next_id == 3
    assert again.committed("accounts").filter(F.col("name").startswith("dirty_")).count() == 0


def test_rows_of_a_session_in_its_index(spark, tmp_path):
    c, log = Catalog(spark, str(tmp_path / "data")), LogManager(spark, str(tmp_path / "log"))
    c.create_table("accounts", ACCOUNTS)
    c.create_index("by_id", "accounts", "id")
    m = TransactionManager(c, log)
    one, two = m.begin(), m.begin()
    rids = [m.insert(one, "accounts", (7, "open")), m.insert(two, "accounts", (7, "second")), m.insert(two, "accounts", (8, "eight"))]
    assert [c.fetch("accounts", r) for r in rids] == [(7, "open"), (7, "second"), (8, "eight")]
    assert [r.name for r in c.lookup("by_id", 7).collect()] == ["open"] and c.index("by_id").count() == 2
    m.commit(two)
    assert [r.name for r in c.lookup("by_id", 7).collect()] == ["second"]  # batches stand before pending rows
    assert sorted(r.name for r in c.lookup_many("by_id", spark.createDataFrame([(7,), (8,), (9,)], "k long")).collect()) == ["eight", "second"]
    assert c.count_rows("accounts") == 3 and c.committed("accounts").count() == 2


def test_recovered_rows_stay_first_and_durable(spark, tmp_path):
    c, log = Catalog(spark, str(tmp_path / "data")), LogManager(spark, str(tmp_path / "log"))
    c.create_table("accounts", ACCOUNTS)
    m = TransactionManager(c, log)
    t = m.begin()
    m.insert(t, "accounts", (1, "first"))
    m.commit(t)
    c.insert_rows("accounts", [(9, "never logged")])
    recovery.recover(c, log.records())
    c.insert_rows("accounts", [(1, "later"), (2, "two")])
    for opened in (c, Catalog(spark, str(tmp_path / "data"))):
        if opened is not c:
            opened.create_table("accounts", ACCOUNTS)
        opened.create_index("by_id", "accounts", "id")
        assert sorted(tuple(r) for r in opened.table("accounts").collect()) == [(1, "first"), (1, "later"), (2, "two")]
        assert [r.name for r in opened.lookup("by_id", 1).collect()] == ["first"] and opened.lookup("by_id", 9).count() == 0


def test_look_ups_read_few_rows(spark, tmp_path):
    """Entries are sorted by key, so statistics rule out most row groups."""
    c = Catalog(spark, str(tmp_path))
    c.create_table("accounts", ACCOUNTS)
    c.create_index("by_id", "accounts", "id")
    c.append("accounts", spark.range(400_000).select(((F.col("id") * 7919) % 400_000).alias("id"), F.col("id").cast("string").alias("name")))
    got = c.lookup("by_id", 123_456)
    assert got.count() == 1
    plan = c._indexed(c.indexes["by_id"]).filter(F.col("key") == 123_456)
    plan.collect()
    executed = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,123456)" in executed
    leaves = plan._jdf.queryExecution().executedPlan().collectLeaves()
    read = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())]
    assert sum(read) < 60_000


def test_transaction_states(spark, tmp_path):
    c, log = Catalog(spark, str(tmp_path / "data")), LogManager(spark, str(tmp_path / "log"))
    c.create_table("accounts", ACCOUNTS)
    m = TransactionManager(c, log)
    t = m.begin()
    assert not m.insert(t, "none", (1, "x")) and not m.insert(t, "accounts", (1, "x" * 5000))
    with pytest.raises(ValueError):
        m.insert(t, "accounts", ("1", "x"))
    m.insert(t, "accounts", (1, "x"))
    m.abort(t)
    assert c.count_rows("accounts") == 1 and c.committed("accounts").count() == 0
    for again in (lambda: m.commit(t), lambda: m.abort(t), lambda: m.insert(t, "accounts", (2, "y"))):
        with pytest.raises(ValueError):
            again()
    assert stats(spark, log.records()) == (3, 0, 1, 0, 1)


def test_binary_log(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    records = [Record(0, 1, RecordType.BEGIN), Record(1, 1, RecordType.INSERT, "accounts", 0, 0, ACCOUNTS.encode((1, "é"))), Record(2, 1, RecordType.COMMIT)]
    raw = b"".join(map(to_bytes, records))
    assert len(to_bytes(records[0])) == 36
    (tmp_path / "wal.log").write_bytes(raw + raw[:3])  # a torn tail
    got = read_log(spark, path)
    assert [(r.lsn, r.type, r.pos) for r in got.orderBy("pos").collect()] == [(0, 1, 0), (1, 2, 36), (2, 3, 36 * 2 + 8 + 14)]
    assert [(r.id, r.name) for r in recovery.decode(recovery.redo(got, ["accounts"]), ACCOUNTS).collect()] == [(1, "é")]
    assert read_log(spark, str(tmp_path / "none.log")).count() == 0
    got.coalesce(1).write.format("tarnlake_log").mode("append").save(str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.log"))
    assert part.read_bytes() == raw


def test_recovery_cases(spark):
    def log(*records):
        return spark.createDataFrame([(i, t, k, n, 0, 0, bytearray(d), i) for i, (t, k, n, d) in enumerate(records)], SCHEMA)

    row = ACCOUNTS.encode((1, "x"))
    assert stats(spark, spark.createDataFrame([], SCHEMA)) == (0, 0, 0, 0, 0)
    assert stats(spark, log((1, 1, "", b""), (1, 2, "accounts", row), (1, 4, "", b""))) == (3, 0, 1, 0, 1)
    assert stats(spark, log((1, 1, "", b""), (1, 3, "", b""), (1, 2, "accounts", row))) == (3, 1, 0, 1, 0)
    assert stats(spark, log((1, 1, "", b""), (1, 2, "gone", row), (1, 3, "", b""))) == (3, 1, 0, 0, 1)
    bad = log((1, 2, "accounts", row[:5]), (1, 3, "", b""))
    assert recovery.decode(recovery.redo(bad, ["accounts"]), ACCOUNTS, strict=False).count() == 0
    with pytest.raises(Exception, match="row ends inside"):
        recovery.decode(recovery.redo(bad, ["accounts"]), ACCOUNTS).collect()


def test_half_published_batches_are_not_read(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("accounts", ACCOUNTS)
    c.insert_rows("accounts", [(1, "x")])
    spark.createDataFrame([(2, "lost")], ACCOUNTS.to_spark()).write.parquet(str(tmp_path / "accounts" / "batch=000000000002"))
    again = Catalog(spark, str(tmp_path))
    again.create_table("accounts", ACCOUNTS)
    assert again.count_rows("accounts") == 1
    again.insert_rows("accounts", [(3, "y")])
    assert {r.id for r in again.committed("accounts").collect()} == {1, 3}
