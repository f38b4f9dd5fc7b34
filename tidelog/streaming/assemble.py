"""Transactions from a stream of change records, with state by transaction.

State holds the changes of open transactions only, a row for each change on the stack, in the state store (RocksDB, which
spills to disk): pushing and taking back a change touch one row, whatever the transaction's size, and a commit streams them out.
Rows come to Python by buckets of transactions, since a call, a frame and the setting of a key for each transaction cost far more
than its records do; a transaction that begins and ends in one batch leaves nothing in the store.
There is no timeout, since a transaction may stay open for ever. The engine's checkpoint keeps source position and state
together, so a restart neither loses nor repeats changes inside the query.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.transactions import CHANGES, INVERSE, XID

OUTPUT = "usn long, slt long, sqn long, scn long, sub_scn int, kind string, obj long, begin_scn long, commit_scn long, num long, n_mismatch long"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Groups that transactions are dealt into by hash; a batch calls Python once for each. A checkpoint holds to this number.
BUCKETS = 1024
#: Rows of one output frame.
CHUNK = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A stream over log files in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def write_log(redo: DataFrame, path: str, number: str) -> int:
    """Records as one file for each ``number``, dealt out by it; files get times in its order, which is the order ``read_log`` sees.

    Returns the count of files; a log without records is one file.
    """
    spark = redo.sparkSession
    redo.repartition(number).write.partitionBy(number).parquet(f"{path}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(path))
    found = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(hadoop.Path(f"{path}-parts")) if "=" in s.getPath().getName())
    for k, folder in found:
        for s in fs.listStatus(folder):
            target = hadoop.Path(path, f"log-{k:06d}-{s.getPath().getName()}")
            fs.rename(s.getPath(), target)
            fs.setTimes(target, 1_000_000_000_000 + k * 1000, -1)
    fs.delete(hadoop.Path(f"{path}-parts"), True)
    if not found:
        redo.drop(number).limit(0).coalesce(1).write.mode("append").parquet(path)
    return max(1, len(found))


class Assembler(StatefulProcessor):
    """Records of one bucket's transactions in order: changes are stacked, an undo takes back the last one if it is its inverse and
    names its object, an end empties the state.

    A commit without a begin emits one row of kind ``PARTIAL`` (no change is shown), so late starts are counted and not lost silently.
    State is asked for once a transaction of the batch, and written only for those that stay open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getMapState("head", "usn long, slt long, sqn long", "begin_scn long, depth int, missed long")
        self.stack = handle.getMapState("stack", "usn long, slt long, sqn long, place int", "scn long, sub_scn int, kind string, obj long")

    def handleInputRows(self, key, rows, timer_values):
        got = pd.concat(list(rows))[[*XID, "scn", "sub_scn", "kind", "obj", "undo_kind"]].sort_values([*XID, "scn", "sub_scn"], kind="stable").astype(object)
        got = got.where(got.notna(), None)
        known, out = self.head.exists(), []
        records = zip(*(got[c].tolist() for c in got.columns), strict=True)
        for xid, own in groupby(records, itemgetter(0, 1, 2)):
            head = self.head.getValue(xid) if known else None
            for row in self._transaction(xid, own, head):
                out.append(row)
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def _transaction(self, xid, records, head):
        begin, depth, missed = head or (None, 0, 0)
        stored, fresh = depth, []  # places below ``stored`` are in the store; ``fresh`` lie on top of them

        def drop(first, last):
            for n in range(first, last):
                self.stack.removeKey((*xid, n))

        for _, _, _, scn, sub_scn, kind, obj, undo_kind in records:
            obj = None if obj is None else int(obj)  # a column with nulls comes as floats
            if kind == "BEGIN":
                begin = scn
            elif kind in CHANGES:
                fresh.append((scn, sub_scn, kind, obj))
            elif kind == "UNDO_LAST":
                last = fresh[-1] if fresh else self.stack.getValue((*xid, stored - 1)) if stored else None
                if last is None or INVERSE[last[2]] != undo_kind or last[3] != obj:
                    missed += 1
                elif fresh:
                    fresh.pop()
                else:
                    stored -= 1
                    drop(stored, stored + 1)
            elif kind in ("COMMIT", "ROLLBACK"):
                if kind == "COMMIT" and begin is None:
                    yield (*xid, scn, sub_scn, "PARTIAL", None, None, scn, stored + len(fresh), missed)
                elif kind == "COMMIT":
                    for n in range(stored + len(fresh)):
                        change = tuple(self.stack.getValue((*xid, n))) if n < stored else fresh[n - stored]
                        yield (*xid, *change, begin, scn, n, missed)
                drop(0, stored)
                begin, stored, fresh, missed = None, 0, [], 0
        for n, change in enumerate(fresh):
            self.stack.updateValue((*xid, stored + n), change)
        depth = stored + len(fresh)
        if begin is None and not depth:
            if head:
                self.head.removeKey(xid)
        else:
            self.head.updateValue(xid, (begin, depth, missed))

    def close(self) -> None:
        pass


def assembled(redo: DataFrame) -> DataFrame:
    """``committed`` and a row of kind ``PARTIAL`` for each commit whose begin wasn't seen."""
    redo.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = redo.select(F.pmod(F.hash(*XID), F.lit(BUCKETS)).alias("bucket"), *(F.col(c).cast("long").alias(c) for c in XID), "scn", "sub_scn", "kind", "obj", "undo_kind")
    return rows.groupBy("bucket").transformWithStateInPandas(Assembler(), OUTPUT, "Append", "None")


def committed(redo: DataFrame) -> DataFrame:
    """Surviving changes of committed transactions, emitted when the commit comes."""
    return assembled(redo).where("kind <> 'PARTIAL'")


def once(messages: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Messages without repeats of (c_scn, c_idx) within the lateness."""
    return messages.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["c_scn", "c_idx"])


def counts(redo: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by kind in tumbling windows of event time."""
    return redo.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Each micro-batch goes to a folder of its number, overwritten if it is run again: exactly once for readers."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def send_batches(messages: DataFrame, send, rules_of, confirmed: str, checkpoint: str, available_now: bool = True):
    """Messages of a stream through ``send(rows)``, with rules read anew for each micro-batch and a confirm checkpoint behind it.

    ``rules_of()`` gives a condition (a column, or None for all) from the configuration as it is now; ``confirmed`` is a folder that
    gets one row for each batch that was sent: its last position, which a restarted client continues from. A batch that is confirmed
    isn't sent again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _there(spark, f"{confirmed}/batch={number}"):
            return
        condition = rules_of()
        send(batch if condition is None else batch.where(condition))
        end = batch.agg(F.max(F.struct("c_scn", "c_idx")).alias("m")).select(F.lit(number).cast("long").alias("number"), "m.*")
        end.coalesce(1).write.mode("overwrite").parquet(f"{confirmed}/batch={number}")

    writer = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
