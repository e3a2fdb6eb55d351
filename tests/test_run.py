from __future__ import annotations

import json

from test_functions import HEADER
from test_sources import ip, rows

from dnslens.plans.run import STAGES, Run, main


def packet(domain: str, *ips: str) -> str:
    labels = "".join(f"{len(x):02x}{x.encode().hex()}" for x in domain.split(".")) + "00"
    answers = "".join(f"c00c000100010000003c0004{ip(a):08x}" for a in ips)
    return HEADER.format(an=len(ips)) + labels + "00010001" + answers


def test_stages_over_a_run_folder(spark, tmp_path):
    scans = tmp_path / "zmap"
    scans.mkdir()
    domains = ["a.example", "b.example", "c.example"]
    (scans / "0f.json").write_text(json.dumps(domains))
    resolvers = {f"30.0.{i}.1": 1 for i in range(30)} | {f"40.0.{i}.1": 2 for i in range(30)}
    lines = []
    for r, asn in resolvers.items():
        for k, d in enumerate(domains):
            usual = ["20.1.0.10"] if k < 2 else ["21.1.0.10"]
            answer = ["10.10.34.34"] if asn == 2 and k == 0 else usual
            lines.append(f"{r},{k},t,{packet(d, *answer)}")
    lines.append(f"30.0.0.1,0,t,{packet('a.example', '20.1.0.10')[:-2]}")
    lines.append(f"99.0.0.1,0,t,{packet('a.example', '20.1.0.10')}")
    (scans / "0f.csv").write_text("\n".join(lines))
    routes = {ip("30.0.0.0"): {16: 1}, ip("40.0.0.0"): {16: 2}, ip("20.1.0.0"): {16: 100}, ip("21.1.0.0"): {16: 101}}
    (tmp_path / "lookup.json").write_text(json.dumps(routes))
    (tmp_path / "whitelist.json").write_text(json.dumps({r: True for r in resolvers} | {"_done": True}))
    (tmp_path / "countries.json").write_text(json.dumps({"AA": [1], "BB": [2], "CC": [100, 101]}))
    (tmp_path / "ptrs.json").write_text('["20.1.0.10",["server1.cdn.net"]]\n["21.1.0.10",["x.other.org"]]\n')
    (tmp_path / "serverheaders.json").write_text('["20.1.0.10",200,"edge"]\n')
    run = Run(spark, str(tmp_path))
    for stage in STAGES.values():
        stage(run)

    obs = run.observations()
    assert rows(obs.filter("domain = 'a.example'"), "resolver_asn", "answer_ip", "n") == [
        (1, ip("20.1.0.10"), 30), (2, ip("10.10.34.34"), 30)
    ]
    assert sorted(r.value for r in spark.read.text(run.path("all-ips")).collect()) == [
        "10.10.34.34/32", "20.1.0.10/32", "21.1.0.10/32"
    ]
    assert rows(run.stored("country-country").filter("domain = 'c.example'"), "resolver_country", "answer_country", "n") == [
        ("AA", "CC", 30), ("BB", "CC", 30)
    ]
    members = {r.domain: r.cluster_id for r in run.stored("clusters").collect()}
    assert set(members) == set(domains) and members["c.example"] not in (members["a.example"],)
    signatures = {(r.domain, r.method): r.value for r in run.stored("signatures").collect()}
    assert signatures[("b.example", "IP")] == ["20.1.0.10"] and signatures[("c.example", "ASN")] == ["101"]
    # Half of a.example's answers are the planted address, so nothing explains three quarters.
    assert not any(d == "a.example" for d, m in signatures if m != "IP")
    assert run.stored("scores").filter("domain = 'b.example'").count() == 1


def test_usage(capsys):
    assert main(["nothing"]) == 2
    assert "aggregate" in capsys.readouterr().err
