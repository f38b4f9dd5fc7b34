"""Codecs, conditions, configuration, stacks, streams and replay against small models."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, formats
from tidelog.operators import checkpoints, condition, dictionary, messages
from tidelog.operators import transactions as tx
from tidelog.plans import config, fixtures, replay
from tidelog.sources import logs, sinks
from tidelog.streaming import assemble


def encode_number(text: str) -> bytes:
    """Base-100 bytes of a decimal text."""
    negative, text = text.startswith("-"), text.lstrip("-")
    whole, _, frac = text.partition(".")
    if not (whole + frac).strip("0"):
        return b"\x80"
    whole = whole.lstrip("0")
    whole = whole.zfill(len(whole) + len(whole) % 2)
    frac += "0" * (len(frac) % 2)
    pairs = [int((whole + frac)[i : i + 2]) for i in range(0, len(whole + frac), 2)]
    exponent = len(whole) // 2
    while pairs and pairs[0] == 0:
        pairs.pop(0)
        exponent -= 1
    while pairs and pairs[-1] == 0:
        pairs.pop()
    if negative:
        return bytes([0x3F - exponent, *(101 - p for p in pairs), 102])
    return bytes([0xC0 + exponent, *(p + 1 for p in pairs)])


def test_number(spark):
    values = ["0", "1", "-1", "100", "123456789012345678901234567890123456789012", "0.5", "-0.00123", "99.99", "-12345.6789", "1000000", "0.0001", "7" + "0" * 100]
    df = spark.createDataFrame([(v, encode_number(v)) for v in values], "v string, b binary")
    assert [(r.v, r.got) for r in df.select("v", codec.number(F.col("b")).alias("got")).collect()] == [(v, v) for v in values]
    bad = spark.createDataFrame([(b"\xc1",), (b"\xc1\x00",), (b"",), (None,)], "b binary")
    assert [r[0] for r in bad.select(codec.or_unknown(codec.number(F.col("b")), F.col("b"))).collect()] == ["?", "?", "?", None]


def test_binary_double(spark):
    def enc(x, f):
        bits = int.from_bytes(struct.pack(">" + f, x), "big")
        top = 1 << (63 if f == "d" else 31)
        bits = bits ^ (2 * top - 1) if bits & top else bits ^ top
        return bits.to_bytes(8 if f == "d" else 4, "big")

    values = [(1.5, "d"), (-2.25, "d"), (0.0, "f"), (float("inf"), "d"), (-3.5, "f")]
    df = spark.createDataFrame([(v, enc(v, f)) for v, f in values], "v double, b binary")
    assert all(r.v == r.got for r in df.select("v", codec.binary_double(F.col("b")).alias("got")).collect())


def test_dates_and_intervals(spark):
    row = spark.createDataFrame(
        [(bytes([120, 122, 5, 1, 7, 1, 1, 7, 91, 205, 21]), bytes([120, 122, 5, 1, 7, 1, 1, 0, 0, 0, 0, 22, 60]), bytes([120, 122, 2, 30, 1, 1, 1]), struct.pack(">I", (1 << 31) + 1) + bytes([68]), struct.pack(">I", (1 << 31) + 1) + bytes([66, 60, 60]) + struct.pack(">I", (1 << 31) + 123456789))],
        "t binary, z binary, bad binary, ym binary, ds binary",
    )
    t, z = codec.timestamp(F.col("t")), codec.timestamp_tz(F.col("z"))
    ym, ds = codec.interval_ym(F.col("ym")), codec.interval_ds(F.col("ds"))
    got = row.select(
        formats.timestamp(t["seconds"], t["nanos"], 8).alias("iso"),
        formats.timestamp(t["seconds"], t["nanos"], 1).alias("us"),
        formats.timestamp_tz(z["seconds"], z["nanos"], z["zone"], 11).alias("tz"),
        codec.timestamp(F.col("bad")).isNull().alias("bad"),
        formats.interval_ym(ym["negative"], ym["year"], ym["month"], 4).alias("ym"),
        formats.interval_ds(*(ds[k] for k in ("negative", "day", "hour", "minute", "second", "nanos")), 9).alias("ds"),
    ).first()
    assert got.iso == "2022-05-01T06:00:00.123456789Z" and got.us == "1651384800123457"
    assert got.tz == "2022-05-01 06:00:00 +02:00" and got.bad
    assert got.ym == "1-8" and got.ds == "1,06:00:00.123456789"


def test_charsets(spark):
    cases = [("ä€", "WE8MSWIN1252", "cp1252"), ("Ж", "CL8KOI8R", "koi8-r"), ("中文", "ZHS16GBK", "gbk"), ("日本", "JA16SJIS", "shift_jis"), ("ß", "WE8ISO8859P1", "latin-1"), ("漢", "AL16UTF16", "utf-16-be"), ("é", "AL32UTF8", "utf-8")]
    for text, name, py in cases:
        df = spark.createDataFrame([(text.encode(py),)], "b binary")
        assert df.select(codec.characters(F.col("b"), name)).first()[0] == text
    bad = spark.createDataFrame([(b"a\xffb",)], "b binary").select(codec.characters(F.col("b"), "AL32UTF8")).first()[0]
    assert bad == "a\ufffdb"
    pair = "\U0001f600".encode("utf-16-be")
    cesu = b"".join(chr(int.from_bytes(pair[i : i + 2], "big")).encode("utf-8", "surrogatepass") for i in (0, 2))
    assert spark.createDataFrame([(cesu,)], "b binary").select(codec.characters(F.col("b"), "UTF8")).first()[0] == "\U0001f600"


def test_condition_language(spark):
    df = spark.createDataFrame([("d", {"login username": "USER1"}), ("c", {}), ("u", {"os terminal": "t"})], "op string, attrs map<string,string>")
    run = lambda t: [r[0] for r in df.select(condition.compile_condition(t, F.col("op"), F.col("attrs"))).collect()]
    assert run("!([op] == 'd' && [login username] == 'USER1')") == [False, True, True]
    assert run("[op] == 'i'") == [False, True, False]
    assert run("[true] || [true] && [false]") == [False] * 3  # one precedence, from the left
    assert run("![true] || [true]") == [True] * 3
    assert run("[OS terminal] == 't'") == [False, False, True]
    assert run("") == [True] * 3
    for bad in ("[op] = 'd'", "[op] == 1", "[op] == 'd' &&! [true]", "([op] == 'd'", "[op]", "'a' == 'b' 'c'"):
        with pytest.raises(condition.ConditionError):
            run(bad)


def full_config(**over):
    source = {"alias": "S1", "name": "DB1", "reader": {"type": "batch", "redo-log": ["/logs"]}, "format": {"type": "debezium"}, "filter": {"table": [{"owner": "A", "table": "T.*"}]}}
    return {"version": config.VERSION, "source": [source], "target": [{"alias": "T1", "source": "S1", "writer": {"type": "discard"}}], **over}


def test_config():
    c = config.parse(json.dumps(full_config()))
    assert c.format.schema == 7 and c.format.xid == 3 and c.state["interval-s"] == 600 and c.tables[0]["table"] == "T.*"
    for bad in ({"version": "0"}, {"source": []}, {"memory": {"min-mb": 64, "max-mb": 32}}, {"surprise": 1}, {"trace": -1}, {"target": [{"source": "X", "writer": {"type": "discard"}}]}):
        with pytest.raises(config.ConfigError):
            config.parse(json.dumps(full_config(**bad)))
    with pytest.raises(config.ConfigError):
        config.parse("{")


def model(rows):
    """Survivors of a transaction's records by a plain stack, and undos that took back nothing."""
    stack, missed = [], 0
    for r in rows:
        if r.kind in tx.CHANGES:
            stack.append(r)
        elif r.kind == "UNDO_LAST" and stack and tx.INVERSE[stack[-1].kind] == r.undo_kind and stack[-1].obj == r.obj:
            stack.pop()
        elif r.kind == "UNDO_LAST":
            missed += 1
    return stack, missed


def test_survivors_equal_a_stack(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    by = {}
    for r in sorted(redo.collect(), key=lambda r: (r.scn, r.sub_scn)):
        by.setdefault((r.usn, r.slt, r.sqn), []).append(r)
    done = {k: model(rows) for k, rows in by.items()}
    assert any(missed for _, missed in done.values()) and any(not missed and any(r.kind == "UNDO_LAST" for r in by[k]) for k, (_, missed) in done.items())
    want = sorted((*k, r.scn, missed) for k, (stack, missed) in done.items() for r in stack)
    assert sorted((r.usn, r.slt, r.sqn, r.scn, r.n_mismatch) for r in tx.survivors(redo).collect()) == want


def test_undo_of_another_object_takes_back_nothing(spark):
    rows = [(1, "BEGIN", None, None), (2, "INSERT", 0, None), (3, "UNDO_LAST", 1, "DELETE"), (4, "UPDATE", 0, None), (5, "UNDO_LAST", 0, "UPDATE"), (6, "DELETE", 0, None), (7, "COMMIT", None, None)]
    redo = spark.createDataFrame([(1, 1, 1, scn, 0, kind, obj, undo, None) for scn, kind, obj, undo in rows], "usn long, slt long, sqn long, scn long, sub_scn int, kind string, obj long, undo_kind string, ts timestamp")
    assert [(r.scn, r.num, r.n_mismatch) for r in tx.committed_changes(redo).orderBy("num").collect()] == [(2, 0, 1), (6, 1, 1)]


def test_place_in_the_log_orders_records_of_one_number(spark):
    rows = [(1, 0, "BEGIN", None, None, 0, 0), (2, 0, "UPDATE", 1, None, 7, 9), (2, 0, "INSERT", 1, None, 7, 3), (2, 0, "UNDO_LAST", 1, "UPDATE", 8, 1), (3, 0, "COMMIT", None, None, 9, 0)]
    full = [(1, 1, 1, scn, sub, kind, obj, undo, block, at, None) for scn, sub, kind, obj, undo, block, at in rows]
    redo = spark.createDataFrame(full, "usn long, slt long, sqn long, scn long, sub_scn int, kind string, obj long, undo_kind string, block long, page_offset int, ts timestamp")
    assert [(r.kind, r.num, r.n_mismatch) for r in tx.committed_changes(redo).collect()] == [("INSERT", 0, 0)]
    assert [r.kind for r in tx.survivors(redo).collect()] == ["INSERT"]


def test_records_of_other_kinds_change_nothing(spark):
    rows = [(1, "BEGIN", None), (2, "INSERT", 0), (3, "LOCK", 0), (4, "LOB_INDEX", 9), (5, "ATTR", None), (6, "SUPP", 0), (7, "UNDO_LAST", 0), (8, "DELETE", 0), (9, "COMMIT", None)]
    full = [(1, 1, 1, scn, 0, kind, obj, "DELETE", None) for scn, kind, obj in rows]
    redo = spark.createDataFrame(full, "usn long, slt long, sqn long, scn long, sub_scn int, kind string, obj long, undo_kind string, ts timestamp")
    assert [(r.scn, r.num, r.n_mismatch) for r in tx.committed_changes(redo).collect()] == [(8, 0, 0)]


def test_one_pass_equals_join(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    cols = [*tx.XID, "scn", "kind", "begin_scn", "commit_scn", "num"]
    joined = tx.commit_order(tx.survivors(redo), tx.transactions(redo)).select(*cols)
    assert sorted(map(tuple, tx.committed_changes(redo).select(*cols).collect())) == sorted(map(tuple, joined.collect()))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    redo = fixtures.redo(spark, sf_dir)
    for seq in range(3):
        redo.where(F.least(F.col("seq"), F.lit(2)) == seq).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = assemble.committed(assemble.read_log(spark, str(tmp_path / "log"), redo.schema))
    assemble.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*tx.XID, "scn", "commit_scn", "num").collect())
    batch = tx.commit_order(tx.survivors(redo), tx.transactions(redo)).select(*tx.XID, "scn", "commit_scn", F.col("num").cast("long"))
    assert got == sorted(tuple(r) for r in batch.collect())


def test_replay_rebuilds_tables(spark, sf_dir):
    """Applying the emitted messages in order gives the same rows as applying the model's."""
    redo = fixtures.redo(spark, sf_dir)
    image = F.create_map(F.lit("ID"), (F.col("scn") % 50).cast("string"), F.lit("SIZE"), F.col("size").cast("string"))
    redo = redo.withColumn("before", F.create_map(F.lit("ID"), (F.col("scn") % 50).cast("string"))).withColumn("after", image)
    rules = [{"owner": "SHOP", "table": "ORDERS"}, {"owner": "SHOP", "table": "CUSTOMER.*", "condition": "[op] != 'd'"}]
    out = replay.replay(redo, fixtures.dictionary(spark, sf_dir), messages.FormatOptions.debezium(database="X"), rules).collect()
    done = {(r.usn, r.slt, r.sqn): r for r in tx.emitted(tx.transactions(redo)).collect()}
    live = [r for r in tx.survivors(redo).collect() if (r.usn, r.slt, r.sqn) in done and r.obj in (0, 1) and not (r.obj == 1 and r.kind == "DELETE")]
    assert len(out) == len(live)

    def apply(items):
        state = {}
        for op, row in items:
            if op == "d":
                state.pop(row["ID"], None)
            else:
                state[row["ID"]] = row["SIZE"]
        return state

    letters = {"INSERT": "c", "UPDATE": "u", "DELETE": "d"}
    mine = [json.loads(r.body)["payload"][0] for r in sorted(out, key=lambda r: (r.commit_scn, r.usn, r.slt, r.sqn, r.num))]
    key = lambda r: (done[r.usn, r.slt, r.sqn].commit_scn, r.usn, r.slt, r.sqn, r.scn)
    wanted = [(letters[r.kind], {"ID": str(r.scn % 50), "SIZE": str(r.size)}) for r in sorted(live, key=key)]
    assert apply((m["op"], m["before"] if m["op"] == "d" else m["after"]) for m in mine) == apply(wanted)


def test_checkpoint_due_is_a_fold(spark):
    rows = [(s, s // 10, 60 * s, s * 400_000) for s in range(40)]
    df = spark.createDataFrame(rows, "scn long, seq long, t long, bytes long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(r.scn for r in checkpoints.due(df, 300, 1, 2).collect())
    want, last = [], None
    for scn, seq, t, b in rows:
        if last is None or last[0] != seq or t - last[1] >= 300 or (b - last[2]) // 1024 // 1024 >= 1:
            want.append(scn)
            last = (seq, t, b)
    assert got == want


def test_probe_and_names(spark):
    head = bytearray(512)
    head[1], head[20:24], head[28:32] = 0x22, (512).to_bytes(4, "little"), bytes([0x7D, 0x7C, 0x7B, 0x7A])
    got = spark.createDataFrame([(bytes(head),), (bytes(512),)], "b binary").select(logs.probe(F.col("b")).alias("p")).collect()
    assert got[0].p.block_size == 512 and not got[0].p.big_endian and got[1].p is None
    assert sinks.file_name("out_%4i_%s.json", 7, 12, "x") == "out_0007_12.json"
    with pytest.raises(ValueError):
        sinks.file_name("out_%q", 1, 1, "")
    with pytest.raises(ValueError):
        logs.pattern("a%")


def test_file_sink_keeps_order(spark, tmp_path):
    m = spark.range(100).repartition(5).select((F.col("id") % 10).alias("c_scn"), F.col("id").alias("c_idx"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("body"), (F.col("id") % 3).alias("seq"))
    sinks.write_lines(m, str(tmp_path / "o"))
    lines = [x for f in sorted((tmp_path / "o").glob("part-*.txt")) for x in f.read_text().split()]
    assert lines == [f"m{i}" for i in sorted(range(100), key=lambda i: (i % 10, i))]
    with pytest.raises(ValueError):
        sinks.write_lines(m, str(tmp_path / "p"), new_line=0)
    sinks.discard(m)


def test_files_by_template(spark, tmp_path):
    m = spark.range(100).repartition(4).select(F.col("id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("body"), F.floor(F.col("id") / 40).alias("seq"))
    text = "".join(f"m{i}" for i in range(100))
    one = sinks.write_files(m, f"{tmp_path}/one.txt", ["id"]).collect()  # no separator at all
    assert [(r.messages, r.bytes) for r in one] == [(100, len(text))] and (tmp_path / "one.txt").read_text() == text
    sinks.write_files(m, f"{tmp_path}/one.txt", ["id"])  # what is there stays
    assert (tmp_path / "one.txt").read_text() == text * 2
    sinks.write_files(m, f"{tmp_path}/s-%s.txt", ["id"], new_line=1)
    assert [(tmp_path / f"s-{k}.txt").read_text().split() for k in range(3)] == [[f"m{i}" for i in range(40 * k, min(100, 40 * k + 40))] for k in range(3)]
    files = sinks.write_files(m, f"{tmp_path}/n-%3i.txt", ["id"], new_line=2, max_file_size=50).collect()
    assert [r.file.rsplit("/", 1)[1] for r in files] == [f"n-{k:03d}.txt" for k in range(len(files))] and max(r.bytes for r in files) <= 50
    assert [x for r in files for x in open(r.file).read().split()] == [f"m{i}" for i in range(100)]
    with pytest.raises(sinks.OutputError):
        sinks.write_files(m, f"{tmp_path}/s-%s.txt", ["id"], append=0)
    for output, size, append in (("x-%i", 0, 1), ("x-%t", 0, 1), ("x", 0, 0), ("x-%q", 9, 1), ("x-%i-%s", 9, 1)):
        with pytest.raises(sinks.OutputError):
            sinks.rotation(output, size, append)
    assert not list(tmp_path.glob(".*.part"))


def test_positions_of_transactions(spark):
    rng = random.Random(6)
    rows, begin = [], 0
    for k in range(300):
        begin = begin if rng.random() < 0.4 else rng.randrange(5)
        rows.append((1, 1, k, k // 7 if k < 200 else 29, begin, 1000 + k, rng.randint(1, 4)))
    tx_rows = spark.createDataFrame(rows, "usn long, slt long, sqn long, seq long, begin_scn long, commit_scn long, n long")
    want, held, last = {}, 0, None
    for _, _, k, _, b, _, n in rows:
        held = held if b == last else 0
        want[k], held, last = held, held + n, b
    assert {r.sqn: r.first_idx for r in tx.message_positions(tx_rows).collect()} == want


def keyed_log(spark, with_types=False):
    """Two tables: one with a key of two columns, one without; nulls and changes of every kind, in one transaction each."""
    rows, scn = [], 0
    rng = random.Random(8)
    for sqn in range(12):
        scn += 1
        rows.append((sqn, scn, "BEGIN", None, None, None))
        for _ in range(rng.randint(1, 6)):
            scn += 1
            kind = rng.choice(["INSERT", "UPDATE", "DELETE"])
            key = {"A": str(rng.randrange(3)), "B": str(rng.randrange(2))}
            image = lambda key=key: key | {"V": rng.choice([None, "x", "y"]), "W": rng.choice([None, "1"])}
            rows.append((sqn, scn, kind, sqn % 2, image() if kind != "INSERT" else None, image() if kind != "DELETE" else None))
        scn += 1
        rows.append((sqn, scn, "COMMIT", None, None, None))
    full = [(1, 1, q, n, 0, n // 10, k, o, None, 10, None, b, a) for q, n, k, o, b, a in rows]
    return spark.createDataFrame(full, "usn long, slt long, sqn long, scn long, sub_scn int, seq long, kind string, obj long, undo_kind string, size long, ts timestamp, before map<string,string>, after map<string,string>")


TABLES = [(0, "S", "KEYED", 0, None, "A,B,V,W", "A,B", False), (1, "S", "BARE", 0, None, "A,B,V,W", None, False), (2, "SYS", "T", 0, None, "A", "A", True)]
TABLE_ROW = "obj long, owner string, name string, valid_from long, valid_to long, columns_text string, key_text string, is_system boolean"


def test_replay_with_composite_keys_rebuilds_rows(spark):
    """Mode 0 leaves out what didn't change, and yet the messages rebuild each row from the one before it."""
    redo, versions = keyed_log(spark), spark.createDataFrame(TABLES, TABLE_ROW)
    out = replay.replay(redo, versions, messages.FormatOptions(), [{"owner": "S", "table": "KEYED"}]).collect()
    rows = {(r.sqn, r.scn): r for r in redo.collect()}
    inside = sorted((r for r in rows.values() if r.obj == 0), key=lambda r: r.scn)
    sent = [json.loads(r.body)["payload"][0] for r in sorted(out, key=lambda r: (r.commit_scn, r.num))]
    assert len(sent) == len(inside)
    for r, m in zip(inside, sent):
        if m["op"] == "u":
            changed = {c for c in "VW" if r.before[c] != r.after[c]}
            assert set(m["after"]) == set(m["before"]) == changed | {"A", "B"}
            assert {**r.before, **m["after"]} == r.after and {**r.after, **m["before"]} == r.before
        else:
            image = r.after if m["op"] == "c" else r.before
            assert m["after" if m["op"] == "c" else "before"] == {c: v for c, v in image.items() if v is not None}


def test_replay_keys_and_modes(spark):
    redo, versions = keyed_log(spark), spark.createDataFrame(TABLES, TABLE_ROW)
    by_rule = replay.replay(redo, versions, messages.FormatOptions(), [{"owner": "S", "table": "BARE", "key": "A, W"}]).collect()
    for r in by_rule:
        for side in ("before", "after"):
            image = json.loads(r.body)["payload"][0].get(side)
            assert image is None or {"A", "W"} <= set(image)
    whole = replay.replay(redo, versions, messages.FormatOptions(column=1), [{"owner": "S", "table": ".*"}]).collect()
    assert all(set(json.loads(r.body)["payload"][0]["after"]) == set("ABVW") for r in whole if r.op == "c")
    with pytest.raises(dictionary.KeyColumnError):
        replay.replay(redo, versions, messages.FormatOptions(), [{"owner": "S", "table": "BARE", "key": "A,NONE"}])
    assert replay.named_tables(versions, [{"owner": ".*", "table": ".*"}]).count() == 2
    assert replay.named_tables(versions, [{"owner": ".*", "table": ".*"}], hide_system=False).count() == 3


def test_null_texts_are_json(spark):
    got = spark.range(1).select(messages.JsonObject().add("a", F.lit(None).cast("string")).add("b", F.lit('"')).column().alias("x")).first().x
    assert json.loads(got) == {"a": None, "b": '"'}


def test_versions_that_overlap_are_found(spark):
    rows = [(1, 0, 10), (1, 9, None), (2, 0, 5), (2, 5, None), (3, 0, None), (3, 4, 6)]
    found = dictionary.overlaps(spark.createDataFrame(rows, "obj long, valid_from long, valid_to long"))
    assert sorted((r.obj, r.valid_from) for r in found.collect()) == [(1, 9), (3, 4)]


def test_split_never_passes_the_limit(spark):
    rng = random.Random(2)
    rows = [(1, 1, k % 5, k, 0, rng.choice([10, 60, 60, 99, 150])) for k in range(200)]
    parts = tx.split(spark.createDataFrame(rows, "usn long, slt long, sqn long, scn long, sub_scn int, size long"), 100)
    for r in parts.groupBy(*tx.XID, "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        assert r.bytes <= 100 or r.n == 1


def test_character_sets():
    with pytest.raises(codec.CharsetError):
        codec.characters(F.lit(b"x"), "NO8SUCH")
    with pytest.raises(codec.CharsetError):
        codec.characters(F.lit(b"x"), "ZHT32EUC")
    for name in set(codec.CHARSETS.values()) - {"cesu-8"}:
        assert b"A".decode(name, "replace") is not None


def test_ebcdic_and_odd_doubles(spark):
    df = spark.createDataFrame([("Zwölf".encode("cp500"), bytes([0xBF, 0xC0, 0, 0])), (None, b"abc"), (b"", bytes([0x40, 0x0F] + [0xFF] * 6))], "t binary, d binary")
    rows = df.select(codec.characters(F.col("t"), "WE8EBCDIC500").alias("t"), codec.binary_double(F.col("d")).alias("d")).collect()
    assert [(r.t, r.d) for r in rows] == [("Zwölf", 1.5), (None, None), ("", -1.0)]


def test_stream_counts_commits_without_begin_and_confirms(spark, tmp_path):
    rows = [(1, 1, 1, 1, 0, "BEGIN", None, None), (1, 1, 1, 2, 0, "INSERT", 5, None), (1, 1, 2, 3, 0, "INSERT", 5, None), (1, 1, 2, 4, 0, "COMMIT", None, None), (1, 1, 1, 5, 0, "COMMIT", None, None)]
    redo = spark.createDataFrame(rows, "usn long, slt long, sqn long, scn long, sub_scn int, kind string, obj long, undo_kind string")
    for k, some in enumerate(("scn <= 3", "scn > 3")):
        redo.where(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    out, chk, confirmed = (str(tmp_path / x) for x in ("out", "chk", "confirmed"))
    rules = [F.col("kind") != "PARTIAL"]
    stream = assemble.assembled(assemble.read_log(spark, str(tmp_path / "log"), redo.schema)).withColumns({"c_scn": F.col("begin_scn"), "c_idx": F.coalesce("num", F.lit(0))})
    sent = []
    assemble.send_batches(stream, lambda rows: sent.extend((r.sqn, r.kind) for r in rows.collect()), lambda: rules[0], confirmed, chk).awaitTermination()
    assert sent == [(1, "INSERT")]
    assert spark.read.parquet(confirmed).agg(F.max("c_scn")).first()[0] == 1


def test_stream_server(spark):
    m = spark.range(20).select(F.col("id").alias("scn"), F.col("id").alias("c_scn"), F.lit(0).alias("c_idx"), F.lit("x").alias("body"))
    server = sinks.StreamServer(m, "DB1")
    assert server.handle({"database": "NO", "code": "INFO"})["code"] == "INVALID_DATABASE"
    assert server.handle({"database": "DB1", "code": "INFO"})["code"] == "READY"
    assert server.handle({"database": "DB1", "code": "START", "scn": 5}).count() == 15
    assert server.handle({"database": "DB1", "code": "START", "scn": 5})["code"] == "ALREADY_STARTED"
    assert server.handle({"database": "DB1", "code": "CONTINUE", "c_scn": 9, "c_idx": 0}).count() == 10
    assert server.handle({"database": "DB1", "code": "CONFIRM", "c_scn": 9, "c_idx": 0})["position"] == (9, 0)
