"""What comes with larger tables: numbers that grow, and steps that must stay dealt out."""

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidelog.functions import formats
from tidelog.plans import fixtures, format_queries, run_queries, stream_queries
from tidelog.sources import sinks
from tidelog.streaming import assemble


@pytest.mark.parametrize("name", ["fmt_timestamp_modes", "fmt_timestamp_tz_modes"])
def test_nanoseconds_beyond_64_bits(spark, tmp_path, name):
    """Event ids of a table of some GB lie beyond 2262, where nanoseconds since 1970 pass 64 bits."""
    ids = [0, 1_880_000, 1_881_000, 5_999_999, 40_000_000]
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r for r in format_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids
    for k, row in got.items():
        nanos = (1_700_000_000 + k * 4001) * 10**9 + k * 104_729_999 % 10**9
        for m, digits in enumerate(formats.PLACES):
            unit = 10 ** (9 - digits)
            want = str((nanos + unit // 2) // unit)
            assert row[f"m{m}"] == (f"{want},Europe/Warsaw" if "tz" in name else want)


def test_epoch_of_far_and_early_seconds(spark):
    rows = spark.createDataFrame([(-1, 500_000_000), (253_402_300_799, 999_999_999), (-62_135_596_800, 1), (None, None)], "s long, ns long")
    got = rows.select(*(formats.timestamp(F.col("s"), F.col("ns"), m) for m in range(4))).collect()
    assert [r[0] for r in got] == ["-500000000", "253402300799999999999", "-62135596799999999999", None]
    assert [r[3] for r in got] == ["0", "253402300800", "-62135596800", None]


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    def told(frames):
        for f in frames:
            yield f.assign(body=f["id"].map("{:05d}".format) + f" {TaskContext.get().partitionId()}")

    m = spark.range(1000).repartition(4).mapInPandas(told, "id long, body string")
    for times in (1, 2):  # the second run adds to the file
        (one,) = sinks.write_files(m, f"{tmp_path}/one.txt", ["id"], new_line=1).collect()
        lines = (tmp_path / "one.txt").read_text().splitlines()
        assert [int(x.split()[0]) for x in lines] == [*range(1000)] * times
        assert (one.messages, one.bytes * times) == (1000, (tmp_path / "one.txt").stat().st_size)
    assert len({x.split()[1] for x in lines}) == 4
    assert not list(tmp_path.glob(".*.part"))
    assert sinks.write_files(m.where("id < 0"), f"{tmp_path}/none.txt", ["id"]).count() == 0


def test_lines_of_one_file_are_read_by_many_tasks(spark, sf_dir, tmp_path):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = run_queries.run_to_file(spark, sf_dir).select("n", "line", F.spark_partition_id().alias("part")).collect()
        assert sorted(r.n for r in out) == [*range(len(out))] and len({r.part for r in out}) > 1
        texts = {"a": ["x" * (k % 300) for k in range(2000)] + ["end"], "b": ["", "ü\r", ""] * 700 + ["end"]}
        for name, lines in texts.items():
            (tmp_path / name).write_bytes("\n".join(lines).encode() + b"\n")
        got = sinks.numbered_lines(spark, [f"file://{tmp_path}/{name}" for name in texts]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    for name, lines in texts.items():
        assert sorted((r.n, r.line) for r in got if r.file.endswith(f"/{name}")) == list(enumerate(lines))
    assert sinks.numbered_lines(spark, []).count() == 0


@pytest.mark.parametrize("name", sorted(stream_queries.QUERIES))
def test_a_long_log_arrives_in_many_files(spark, sf_dir, monkeypatch, name):
    want = stream_queries.QUERIES[name](spark, sf_dir).collect()
    monkeypatch.setattr(stream_queries, "NUMBERS_A_FILE", 90, raising=False)
    folder, schema, *a_part = stream_queries._log(spark, sf_dir)
    log = spark.read.schema(schema).parquet(folder)
    files = log.groupBy("_metadata.file_path").agg(F.max("_metadata.file_modification_time").alias("t"), F.min("scn").alias("low"), F.max("scn").alias("high")).orderBy("low").collect()
    assert len(files) == 12 and a_part == [3] and log.count() == fixtures.redo(spark, sf_dir).count()
    assert all(a.t < b.t and a.high < b.low and a.high - a.low < 90 for a, b in zip(files, files[1:], strict=False))
    assert sorted(want) == sorted(stream_queries.QUERIES[name](spark, sf_dir).collect())


@pytest.mark.parametrize("name", sorted(stream_queries.QUERIES))
def test_an_empty_log_arrives(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert stream_queries.QUERIES[name](spark, str(tmp_path)).count() == 0


class Store:
    """Map states in memory, which count how often they are asked."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getMapState(self, name, *schemas):
        self.rows[name] = held = {}

        class State:
            def exists(_):
                return self.called(bool(held))

            def getValue(_, key):
                return self.called(held.get(key))

            def updateValue(_, key, value):
                self.called(held.__setitem__(key, value))

            def removeKey(_, key):
                self.called(held.pop(key))

        return State()

    def called(self, value):
        self.calls += 1
        return value


def test_state_is_asked_for_open_transactions_only():
    columns = ["usn", "slt", "sqn", "scn", "sub_scn", "kind", "obj", "undo_kind"]
    store, rows = Store(), assemble.Assembler()
    rows.init(store)

    def run(records):
        frames = [pd.DataFrame(records[k::2], columns=columns) for k in range(2)]
        got = [x for f in rows.handleInputRows((0,), iter(frames), None) for x in f.itertuples(index=False, name=None)]
        return [(x[2], x[3], x[5], x[9]) for x in got]

    whole = [r for k in range(500) for r in ((1, 2, k, 10 * k, 0, "BEGIN", None, None), (1, 2, k, 10 * k + 1, 1, "INSERT", 7, None), (1, 2, k, 10 * k + 2, 1, "COMMIT", None, None))]
    assert run(whole) == [(k, 10 * k + 1, "INSERT", 0) for k in range(500)]
    assert store.calls == 1  # whether anything is open, and nothing for the 500 transactions
    # One that spans batches: of three stored changes one is taken back, one more comes; another is rolled back.
    run([(1, 2, 9, 1, 0, "BEGIN", None, None), *((1, 2, 9, n, 1, "UPDATE", n, None) for n in (2, 3, 4)), (1, 2, 8, 2, 0, "BEGIN", None, None), (1, 2, 8, 3, 0, "DELETE", 1, None)])
    assert len(store.rows["head"]) == 2 and len(store.rows["stack"]) == 4
    run([(1, 2, 9, 5, 1, "UNDO_LAST", 4, "UPDATE"), (1, 2, 9, 6, 1, "UNDO_LAST", 99, "UPDATE")])
    assert len(store.rows["stack"]) == 3
    assert run([(1, 2, 9, 7, 1, "DELETE", 5, None), (1, 2, 9, 8, 1, "COMMIT", None, None), (1, 2, 8, 9, 1, "ROLLBACK", None, None), (1, 2, 6, 9, 1, "COMMIT", None, None)]) == [(6, 9, "PARTIAL", 0), (9, 2, "UPDATE", 0), (9, 3, "UPDATE", 1), (9, 7, "DELETE", 2)]
    assert store.rows == {"head": {}, "stack": {}}
