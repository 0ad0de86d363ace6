"""Inputs and outputs in their own formats."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from dnsketch.sources import dnslog, files, generator, wire


def test_text_log(spark, tmp_path):
    p = tmp_path / "log.gz"
    with gzip.open(p, "wt") as f:
        f.write("# a remark\n1710000000 198.51.100.9 till-4.bakery.test./1/1\nnot a line\n1710000007 2001:db8::aa cases.law.test./28/1\n")
    got = sorted(dnslog.text_log(spark, str(p)).select(F.col("ts").cast("long"), "client", "qname", "qtype", "qclass").collect())
    assert list(map(tuple, got)) == [(1710000000, "198.51.100.9", "till-4.bakery.test", 1, 1), (1710000007, "2001:db8::aa", "cases.law.test", 28, 1)]


def test_frames():
    good = wire.encode_frame(5, "2001:db8::1", "a.example.", "AAAA", "IN")
    other = wire.encode_frame(6, "1.2.3.4", "b.example", "A", "IN", kind=6)
    stream = wire.encode_stream([good, b"x" * (wire.LARGEST_FRAME + 1), b"\xff\xff", other])
    got = [wire.decode(f) for f in wire.frames(stream)]
    assert [r["qname"] for r in got] == ["a.example.", None, "b.example."]
    assert got[0] == {"ts": 5, "client": "2001:db8::1", "qname": "a.example.", "qclass": "IN", "qtype": "AAAA", "msg_type": "CLIENT_QUERY"} and got[2]["msg_type"] == "CLIENT_RESPONSE"
    assert list(wire.frames(b"\0\0\0\0\0\0\xff\xff")) == [] and list(wire.frames(stream[:-20]))


def test_compressed_name():
    q = wire.encode_question("a.example", "A", "IN")
    m = q[:12] + b"\x01b\xc0\x0e" + q[-4:]  # points into itself only where a name is
    assert wire.question(q)[0] == "a.example."
    with pytest.raises(ValueError):
        wire.question(m[:-3])


def test_capture():
    items = [(9, "10.0.0.1", wire.encode_question("WWW.Example", "A", "IN")), (9, "10.0.0.1", wire.encode_question("x", "TXT", "IN"))]
    got = [wire.captured_query(s, p) for s, p in wire.packets(wire.encode_capture(items))]
    assert got[0]["qname"] == "www.example" and got[1] is None


def test_config(tmp_path):
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.conf").write_text("number_of_hashes 5 # five\n")
    (tmp_path / "more" / "a.conf").write_text("number_of_hashes 4\n")
    main = tmp_path / "main.conf"
    main.write_text("; main\nperiod_length 86400\nnumber_of_bits_per_filter 8388608\nnumber_of_filters 6\nnumber_of_filters_per_user 3\ninclude more\ninclude gone if_exist\n")
    cfg = files.bloom_config(files.config(str(main)))
    assert (cfg.filters, cfg.bits, cfg.hashes, cfg.per_user, cfg.flatten) == (6, 8388608, 5, 3, 0)
    loop = tmp_path / "loop.conf"
    loop.write_text("include loop.conf\n")
    with pytest.raises(ValueError, match="nested"):
        files.config(str(loop))
    with pytest.raises(ValueError, match="lacks"):
        files.bloom_config({"period_length": "5"})
    loop.write_text("no end")
    with pytest.raises(ValueError, match="last line"):
        files.lines(str(loop))


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("1710000000, Q(Q), 198.51.100.9, IN, A, Till-4.bakery.test.\n1710000001, R(Q), 198.51.100.9, IN, A, no.\n")
    assert [r["name"] for r in files.ground_truth(spark, str(tmp_path / "gt.csv")).collect()] == ["Till-4.bakery.test"]
    (tmp_path / "b.csv").write_text(" Bad.example ,x\nbad.example,y\n")
    assert [r[0] for r in files.first_column(spark, str(tmp_path / "b.csv")).collect()] == ["bad.example"]
    (tmp_path / "m.log").write_text("2024-03-09T18:00:00+02:00 198.51.100.9\n")
    assert files.mail_log(spark, str(tmp_path / "m.log")).select(F.col("ts").cast("long")).first()[0] == 1710000000
    (tmp_path / "s.csv").write_text("organisation,code\nBakery,food\n")
    assert tuple(files.sector_map(spark, str(tmp_path / "s.csv"), "organisation", "code").first()) == ("Bakery", "food")


def test_experiment_log(spark):
    text = "Statistics for 2024-03-09.hs.json:\n[3 / 10] found\nother\nStatistics for 2024-03-10.hs.json:\n  [ 4 / 9 ]\n"
    got = files.experiment_log(spark.createDataFrame([(text,)], "value string")).collect()
    assert [tuple(r) for r in got] == [("2024-03-09", 3, 10), ("2024-03-10", 4, 9)]


def test_results(spark, tmp_path):
    r = spark.createDataFrame([('{"first_request":1,"last_request":2,"groups":[{"hostnames":{"a":1,"b":2}}]}', "p")], "result string, period_end string")
    files.write_results(r, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(x["host"] for x in files.result_hosts(back).collect()) == ["a", "b"]
    files.write_csv(spark.createDataFrame([("x", 1)], "sector string, count int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["sector", "count"]


def test_generated_queries_repeat(spark):
    a, b = (generator.random_queries(spark, 50).collect() for _ in range(2))
    assert a == b and all(5 <= len(r["qname"].split(".")[1]) <= 15 for r in a) and {r["qtype"] for r in a} <= set(generator.TYPES)


def test_collector_and_its_stream(spark, tmp_path):
    import asyncio

    from dnsketch.sources.collector import Collector, control, dnstap_stream

    folder, path = str(tmp_path / "drop"), str(tmp_path / "s.sock")
    sent = [wire.encode_frame(100 + i, "10.0.0.1", f"h{i}.example", "A", "IN") for i in range(5)]
    c = Collector(folder, most=3 * len(sent[0]))

    async def play():
        stop = asyncio.Event()
        server = asyncio.create_task(c.run(path, stop))
        while not (tmp_path / "s.sock").exists():
            await asyncio.sleep(0.01)
        r, w = await asyncio.open_unix_connection(path)
        w.write(control(wire.READY, wire.CONTENT_TYPE))
        answer = await r.readexactly(len(control(wire.ACCEPT, wire.CONTENT_TYPE)))
        w.write(control(wire.START, wire.CONTENT_TYPE))
        for f in [*sent, b"z" * (wire.LARGEST_FRAME + 1)]:
            w.write(len(f).to_bytes(4, "big") + f)
        w.write(control(wire.STOP))
        end = await r.read()
        r2, w2 = await asyncio.open_unix_connection(path)  # breaks the rules
        w2.write((5).to_bytes(4, "big") + b"hello")
        await r2.read()
        stop.set()
        await server
        return answer, end

    answer, end = asyncio.run(play())
    assert answer == control(wire.ACCEPT, wire.CONTENT_TYPE) and end == control(wire.FINISH)
    assert (c.skipped, c.broken) == (1, 1) and len(list((tmp_path / "drop").iterdir())) == 2
    q = dnstap_stream(spark, folder, 1).writeStream.format("memory").queryName("taps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["qname"] for r in spark.table("taps").collect()) == [f"h{i}.example." for i in range(5)]


def test_shared_folder_is_needed_off_local_masters():
    from types import SimpleNamespace

    from dnsketch.session import shared_base

    def fake(master, base=None):
        kept = {"spark.checkpoint.dir": base} if base else {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: kept.get(k, d), set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))

    assert shared_base(fake("spark://x:1", "hdfs://x/y")) == "hdfs://x/y" and shared_base(fake("local[2]"))
    for master in ("spark://x:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_base(fake(master))


def test_collected_frames_become_states(spark, tmp_path):
    """Dropped files, the command line's watch with definitions, a second run with one more file, and an empty end."""
    import json

    from dnsketch import cli
    from dnsketch.functions.hashing import sha256
    from dnsketch.sources.collector import Collector

    drop, cfg, nets, job, out = (str(tmp_path / x) for x in ("drop", "c.conf", "nets.json", "job.json", "out"))
    with open(cfg, "w") as f:
        f.write("period_length 3600\nnumber_of_filters 1\nnumber_of_bits_per_filter 65536\nnumber_of_hashes 4\nnumber_of_filters_per_user 1\n")
    with open(nets, "w") as f:
        f.write('{"subnet_activity":[{"entity":"Bakery","prefixes":[{"2001:db8:7::":48}]}]}')
    with open(job, "w") as f:
        f.write(json.dumps({"groups": [{"id": 1, "hostnames": {"t": sha256("Bakery@till.test"), "m": sha256("UNKNOWN@maps.test")}}]}))
    c, start = Collector(drop), 1_709_999_000
    for run, at in enumerate((start, start + 5)):
        for i, client in enumerate(("2001:db8:7::1", "2001:db8:7::2", "198.51.100.1")):
            c.add(wire.encode_frame(at + i, client, ("Till.test.", "till.test", "maps.test")[i], "A", "IN"))
        c.drop()
        cli.main(["watch", "-c", cfg, "-l", drop, "-o", out, "-s", nets])
        cli.main(["search", "-c", cfg, "-f", out, "-j", job, "-r", str(tmp_path / f"r{run}")])
        got = json.loads(spark.read.text(str(tmp_path / f"r{run}")).first()["value"])
        assert got["groups"][0]["hostnames"] == {"m": 1, "t": 1} and got["number_of_requests"] == 3 * (run + 1) and got["estimated_number_of_clients"] == 3


def test_merged_parts_and_a_replayed_batch(spark, tmp_path):
    import datetime as dt

    from dnsketch.model import SINGLE
    from dnsketch.streaming import periods

    rows = [(dt.datetime(2024, 3, 9, 6, 0, i), 10 + i, f"h{i}.test", "A", None) for i in range(8)]
    df = spark.createDataFrame(rows, "ts timestamp, ip long, host string, qtype string, entity string")
    path = str(tmp_path / "parts")
    for n in range(4):
        periods.add_parts(df.filter(f"ip % 4 = {n}"), SINGLE, path, n)

    def now():
        s = periods.periods(spark, path, SINGLE)
        return s.header.select("number_of_requests", "est_clients").first(), s.filter.select("bits_set").first()

    want = now()
    periods.compact(spark, path, SINGLE)
    periods.add_parts(df.filter("ip % 4 = 3"), SINGLE, path, 3)  # the last batch, written again after a crash
    assert now() == want and sorted(p.name for p in (tmp_path / "parts" / "counts").iterdir()) == ["batch=-1", "batch=3"]
    periods.add_parts(df.withColumn("ip", F.col("ip") + 100), SINGLE, path, 4)
    periods.compact(spark, path, SINGLE)
    assert now()[0]["number_of_requests"] == 16 and sorted(p.name for p in (tmp_path / "parts" / "hll").iterdir()) == ["batch=-1", "batch=4"]


def test_messages_have_levels(capsys):
    from dnsketch import cli

    for level, shown in ((0, ["warning"]), (1, ["info", "warning"]), (-1, [])):
        cli.log_to(level, False)
        cli.log.info("info")
        cli.log.warning("warning")
        assert [x.rpartition(" ")[2] for x in capsys.readouterr().err.splitlines()] == shown


def test_minute_counters_of_overlapping_files(spark, tmp_path):
    import shutil

    from dnsketch.plans import catalogue

    one = "/root/testdata/sf0.001"
    shutil.copy(f"{one}/pages.parquet", tmp_path / "pages.parquet")
    events = spark.read.parquet(f"{one}/events.parquet")
    for k in range(3):  # every file spans the whole time
        events.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, catalogue.stream_minutely(spark, one).collect()))
    assert sorted(map(tuple, catalogue.stream_minutely(spark, str(tmp_path)).collect())) == want
    assert sum(r[1] for r in want) == events.count()
