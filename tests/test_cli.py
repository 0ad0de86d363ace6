"""The command line, end to end."""

from __future__ import annotations

import datetime as dt
import json

from dnsketch import cli
from dnsketch.functions.hashing import sha256


def test_gather_search_info_combine_advise(spark, tmp_path, capsys):
    rows = [(dt.datetime(2024, 1, 1, h, 5), c, n, k, t, "CLIENT_QUERY") for h, c, n, k, t in ((1, "10.1.0.5", "WWW.Example.org.", "IN", "A"), (2, "10.2.0.5", "other.example", "IN", "MX"), (3, "2001:db8::1", "six.example", "IN", "AAAA"), (3, "10.1.0.5", "no.example", "CH", "A"), (4, None, "gone.example", "IN", "A"))]
    log, cfg, nets, job, state, day = (str(tmp_path / x) for x in ("log", "c.conf", "nets.json", "job.json", "state", "day"))
    spark.createDataFrame(rows, "ts timestamp, client string, qname string, qclass string, qtype string, msg_type string").write.parquet(log)
    open(cfg, "w").write("period_length 3600\nnumber_of_filters 1\nnumber_of_bits_per_filter 65536\nnumber_of_hashes 4\nnumber_of_filters_per_user 1\n")
    open(nets, "w").write('{"subnet_activity":[{"entity":"Org","prefixes":[{"10.1.0.0":16},{"2001:db8::":32}]}]}')
    open(job, "w").write(json.dumps({"groups": [{"id": 4, "hostnames": {"w": sha256("Org@www.example.org"), "s": sha256("Org@six.example"), "o": sha256("UNKNOWN@other.example"), "g": sha256("gone.example")}}]}))
    cli.main(["gather", "-c", cfg, "-l", log, "-o", state, "-s", nets])
    cli.main(["search", "-c", cfg, "-f", state, "-j", job])
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [g["groups"][0]["hostnames"] for g in got] == [{"w": 1}, {"o": 1}, {"s": 1}] and all(g["number_of_requests"] == 1 for g in got)
    cli.main(["combine", "-c", cfg, "-o", day, state])
    cli.main(["search", "-c", cfg, "-f", day, "-j", job, "-r", str(tmp_path / "out")])
    whole = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert whole["groups"] == [{"hostnames": {"o": 1, "s": 1, "w": 1}, "id": 4, "hits_by_all_hostnames": 0}] and whole["number_of_requests"] == 3 and whole["estimated_number_of_clients"] == 3
    cli.main(["info", "-c", cfg, "-f", day])
    report = capsys.readouterr().out
    assert [x for x in report.splitlines() if x.startswith("##")] == ["## Version information ##", "## Period information ##", "## Filter configuration ##", "## Filter information ##"]
    assert "Number of requests            : 3" in report and "Estimated number of clients   : 3" in report and " 1. Number of bits set: " in report
    cli.main(["info", "-c", cfg, "-f", day, "-p"])
    cli.main(["advise", "-l", log])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("1704") and len(lines) == 7
