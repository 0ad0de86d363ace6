"""Command line: gather, collect, watch, search, info, combine, advise.

    python -m dnsketch.cli gather  -c CONFIG -l LOG -o STATE [-s SUBNETS] [-k parquet|text|dnstap|capture]
    python -m dnsketch.cli collect -u SOCKET -o FOLDER
    python -m dnsketch.cli watch   -c CONFIG -l FOLDER -o STATE [-s SUBNETS]
    python -m dnsketch.cli search  -c CONFIG -f STATE -j JOB [-r RESULT]
    python -m dnsketch.cli info    -c CONFIG -f STATE [-p]
    python -m dnsketch.cli combine -c CONFIG -o DST SRC
    python -m dnsketch.cli advise  -l LOG [-k KIND]

Before the command: -v or -vv for more messages, -q for fewer, --syslog to send them to the system log.
"""

from __future__ import annotations

import argparse
import asyncio
import logging
import logging.handlers
import signal
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.operators import metrics, search, sketch
from dnsketch.operators.report import info_text
from dnsketch.session import session
from dnsketch.sources import files, wire
from dnsketch.sources.collector import Collector, dnstap_stream
from dnsketch.sources.dnslog import any_lookups, text_log
from dnsketch.streaming import periods

log = logging.getLogger("dnsketch")


def accepted_log(spark: SparkSession, path: str, subnets: str | None, kind: str = "parquet") -> DataFrame:
    """Accepted lookups of a log, of IPv4 and IPv6 clients, with their organisation.

    kind: parquet (ts, client, qname, qclass, qtype, msg_type), text lines, dnstap frame streams, or packet captures.
    """
    return any_lookups(raw_log(spark, path, kind), files.subnet_file(spark, subnets) if subnets else None)


def raw_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "text":
        name = lambda c, known: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(c)], F.concat(F.lit("#"), c))
        t = text_log(spark, path)
        return t.select("ts", "client", "qname", name("qclass", wire.QCLASSES).alias("qclass"), name("qtype", wire.QTYPES).alias("qtype"), F.lit("CLIENT_QUERY").alias("msg_type"))
    got = wire.dnstap_files(spark, path) if kind == "dnstap" else wire.capture_files(spark, path)
    return got.withColumn("ts", F.timestamp_seconds("ts"))


def gather(a, spark):
    cfg = files.bloom_config(files.config(a.config))
    sketch.persist(sketch.build_state(accepted_log(spark, a.log, a.subnets, a.kind), cfg), a.out)


def watch(a, spark):
    """Frame streams that a collector drops into a folder become period states; definitions are read anew for each batch."""
    cfg = files.bloom_config(files.config(a.config))

    def found(batch: DataFrame) -> DataFrame:
        start = time.monotonic()
        prefixes = files.subnet_file(spark, a.subnets) if a.subnets else None
        log.info("definitions read in %.0f ms", 1000 * (time.monotonic() - start))
        return any_lookups(batch.withColumn("ts", F.timestamp_seconds("ts")), prefixes)

    periods.run_periods(dnstap_stream(spark, a.log), cfg, f"{a.out}/parts", found).awaitTermination()
    sketch.persist(periods.periods(spark, f"{a.out}/parts", cfg), a.out)


def collect(a, spark):
    """Listens on a unix socket and drops frame streams into a folder, until it is interrupted."""

    async def run() -> None:
        stop = asyncio.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            asyncio.get_running_loop().add_signal_handler(s, stop.set)
        c = Collector(a.out)
        await c.run(a.socket, stop)
        log.info("collector: %d frames too long, %d senders broke the rules", c.skipped, c.broken)

    asyncio.run(run())


def search_(a, spark):
    state = sketch.load(spark, a.state, files.bloom_config(files.config(a.config)))
    jobs = spark.read.text(a.job, wholetext=True).select(F.lit(1).alias("job_id"), F.col("value").alias("job"))
    out = search.results(jobs, state, a.threshold)
    if a.result:
        files.write_results(out, a.result)
    else:
        for r in out.orderBy("period_end").toLocalIterator():
            print(r["result"])


def info(a, spark):
    state = sketch.load(spark, a.state, files.bloom_config(files.config(a.config)))
    if a.plot:
        rows = state.header.join(sketch.filter_info(state), "period_end").orderBy("period_end", "filter_idx")
        for r in rows.toLocalIterator():
            print(f"{int(r['period_begin'].timestamp())},{r['estimate']}")
    else:
        for r in info_text(state).orderBy("period_end").toLocalIterator():
            print(r["report"])


def combine(a, spark):
    """Fails, and leaves the destination as it was, if the states differ in geometry."""
    cfg = files.bloom_config(files.config(a.config))
    sketch.persist(sketch.combined(sketch.load(spark, a.source, cfg), a.length), a.out)


def advise(a, spark):
    """The advice, then a line for each hour and day."""
    rows = accepted_log(spark, a.log, None, a.kind)
    for name, length in (("hourly", 3_600), ("daily", 86_400)):
        n = metrics.distinct_tokens(rows, length).agg(F.max("n").alias("n"))
        for r in metrics.advice(n, "n").orderBy("one_in").toLocalIterator():
            print(f"{name}: for a false-positive rate of 1 / {r['one_in']} and {r['n']} names: m = {r['m']}, k = {r['k']}")
    for name, length in (("hour", 3_600), ("day", 86_400)):
        for r in metrics.distinct_tokens(rows, length).orderBy("window_start").toLocalIterator():
            log.info("%s of %s: %d names", name, r["window_start"].isoformat(), r["n"])


def log_to(level: int, syslog: bool) -> None:
    """Warnings and errors; one -v adds information, two debugging, each -q takes a level away."""
    handler = logging.handlers.SysLogHandler("/dev/log") if syslog else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("dnsketch: %(levelname)s: %(message)s" if syslog else "%(asctime)s %(levelname)s: %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(max(logging.DEBUG, min(logging.CRITICAL, logging.WARNING - 10 * level)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="dnsketch")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="count", default=0)
    p.add_argument("--syslog", action="store_true", help="messages go to the system log instead of standard error")
    sub = p.add_subparsers(required=True)
    for name, f, opts in (
        ("gather", gather, ("-c config", "-l log", "-o out", "-s subnets?", "-k kind?")),
        ("watch", watch, ("-c config", "-l log", "-o out", "-s subnets?")),
        ("collect", collect, ("-u socket", "-o out")),
        ("search", search_, ("-c config", "-f state", "-j job", "-r result?")),
        ("info", info, ("-c config", "-f state")),
        ("combine", combine, ("-c config", "-o out")),
        ("advise", advise, ("-l log", "-k kind?")),
    ):
        s = sub.add_parser(name)
        s.set_defaults(run=f)
        for o in opts:
            flag, dest = o.rstrip("?").split()
            more = {"default": "parquet", "choices": ("parquet", "text", "dnstap", "capture")} if dest == "kind" else {}
            s.add_argument(flag, f"--{dest}", dest=dest, required=not o.endswith("?"), **more)
        if name == "search":
            s.add_argument("-t", "--threshold", type=int, default=0, help="flatten below so many host names; 0 never does")
        if name == "info":
            s.add_argument("-p", "--plot", action="store_true")
        if name == "combine":
            s.add_argument("source")
            s.add_argument("--length", type=int, default=86_400)
    a = p.parse_args(argv)
    log_to(a.verbose - a.quiet, a.syslog)
    a.run(a, None if a.run is collect else session())


if __name__ == "__main__":
    main()
