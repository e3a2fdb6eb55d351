from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dnslens import functions as fn

HEADER = "abcd81800001{an:04x}00000000"
NAME = "026431" + "076578616d706c65" + "00"
QUESTION = NAME + "00010001"


def a_record(ip_hex: str, owner: str = "c00c") -> str:
    return owner + "000100010000003c0004" + ip_hex


def packet(*records: str, header: str = HEADER, question: str = QUESTION) -> str:
    return header.format(an=len(records)) + question + "".join(records)


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_ip_to_long_accepts_only_dotted_quads(spark):
    values = ["8.8.8.8", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", None, "::1", "1..2.3"]
    assert column(spark, values, fn.ip_to_long) == [134744072, 4294967295, 0] + [None] * 8


def test_format_ip_reverses_ip_to_long(spark):
    rng = random.Random(1)
    values = [rng.randrange(2**32) for _ in range(500)] + [0, 2**32 - 1]
    assert column(spark, values, lambda c: fn.ip_to_long(fn.format_ip(c)), "bigint") == values
    assert column(spark, [None], fn.format_ip, "bigint") == [None]


def test_prefix_and_class_c(spark):
    ip = 20 * 2**24 + 4 * 2**16 + 1 * 2**8 + 200
    assert column(spark, [ip], fn.class_c, "bigint") == [ip - 200]
    assert column(spark, [ip], lambda c: fn.prefix(c, 9), "bigint") == [20 * 2**24]


def test_is_reserved(spark):
    inside = ["10.1.1.1", "100.64.0.1", "172.31.0.1", "192.168.9.9", "192.0.2.5", "192.0.0.1", "224.0.0.1", "255.255.255.255", "198.19.0.1", "127.0.0.1"]
    outside = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "198.20.0.1", "192.0.1.1", "11.0.0.0"]
    got = column(spark, inside + outside, lambda c: fn.is_reserved(fn.ip_to_long(c)))
    assert got == [True] * len(inside) + [False] * len(outside)


def test_ptr_base_domain(spark):
    values = ["a.b.example.co.uk", "host.example.com", "x.co.uk", "localhost", ".bad.com", "", None]
    assert column(spark, values, fn.ptr_base_domain) == ["example", "example", "co", None, None, None, None]


def test_clean_metadata_tag(spark):
    values = [" Server01.CDN.net ", "www.cdn.net", "Acme Networks Inc", "", None, "toolongname.net"]
    want = ["cdn.net", "www.cdn.net", "acme networks inc", None, None, "toolongname.net"]
    assert column(spark, values, fn.clean_metadata_tag) == want


def test_whois_org_takes_the_last_owner_line(spark):
    values = ["netname: A\nOrgNOCName:  B \ncountry: X", "OrgNOCName: B\nnetname: A", "country: X", None]
    assert column(spark, values, fn.whois_org) == ["B", "A", None, None]


def test_redirect_host(spark):
    rows = [(301, "https://www.a.example/x"), (302, "http://b.example"), (200, "http://c.example"), (301, "/rel"), (399, "http:///x")]
    df = spark.createDataFrame(rows, "status int, location string")
    got = [r[0] for r in df.select(fn.redirect_host("status", "location")).collect()]
    assert got == ["www.a.example", "b.example", None, None, None]


def test_asn_and_status_labels(spark):
    assert column(spark, ["3356", "ZZ", "unknown", None], fn.asn_or_unknown) == [3356, None, None, None]
    labels = column(spark, [-1, -5, 200], fn.favicon_status_label, "int")
    assert labels == ["Could not connect to the server", "Unknown error occured", None]


def decode(spark, packets):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(packets)], "i int, data_hex string")
    return fn.response_fields(df.repartition(2)).orderBy("i").collect()


def test_decode_answers(spark):
    alias = "c00c000500010000003c0002c00c"
    rows = decode(
        spark,
        [
            packet(a_record("08080808")),
            packet(alias, a_record("01020304", NAME), a_record("01020305")),
            packet(),
            packet(a_record("08080808").replace("c00c0001", "c00c001c", 1)),
        ],
    )
    assert all(r.ok and r.qr == 1 and r.ra == 1 and r.qdcount == 1 for r in rows)
    assert [r.qname for r in rows] == ["d1.example"] * 4
    assert [r.a_records for r in rows] == [[134744072], [16909060, 16909061], [], []]
    assert [r.first_a for r in rows] == [134744072, None, None, None]
    assert [r.ancount for r in rows] == [1, 3, 0, 1]


def test_header_test_agrees_with_the_decoder(spark):
    rng = random.Random(3)
    packets = [packet(*[a_record("08080808")] * rng.randrange(3), header=f"abcd{rng.randrange(65536):04x}0001{{an:04x}}00000000") for _ in range(200)]
    packets += ["", None, "abcd", "zz" * 30]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(packets)], "i int, data_hex string")
    quick = {r.i for r in df.filter(fn.answered_recursively("data_hex")).collect()}
    decoded = fn.response_fields(df).filter("ok and qr = 1 and ra = 1 and ancount > 0").collect()
    assert quick == {r.i for r in decoded} and len(quick) > 20


def test_decode_flags_and_case(spark):
    query = packet(header="abcd03030001{an:04x}00000000")
    upper = packet(a_record("08080808"), question=QUESTION.replace("6431", "4431"))
    first, second = decode(spark, [query, upper])
    assert (first.qr, first.ra, first.rcode) == (0, 0, 3)
    assert second.qname == "d1.example"


@pytest.mark.parametrize(
    "bad",
    [
        packet(a_record("08080808"))[:-2],
        packet(a_record("08080808"))[:-1],
        packet(a_record("08080808"))[:30],
        "zz" * 20,
        "",
        None,
        "abcd",
        packet(a_record("08080808"), question="c00c00010001"),
        packet(a_record("08080808", owner="c0ff")),
        packet(a_record("08080808", owner="40")),
        HEADER.format(an=9) + QUESTION + a_record("08080808"),
        packet("c00c000100010000003c000308080808"),
    ],
)
def test_decode_never_raises(spark, bad):
    row = decode(spark, [bad, packet(a_record("08080808"))])
    assert not row[0].ok and row[0].a_records == [] and row[0].qname is None
    assert row[1].ok and row[1].a_records == [134744072]


def test_decode_without_question(spark):
    row = decode(spark, [HEADER.replace("0001{", "0000{").format(an=0)])[0]
    assert row.ok and row.qname is None and row.qdcount == 0


def test_decode_random_bytes(spark):
    rng = random.Random(7)
    noise = ["".join(f"{rng.randrange(256):02x}" for _ in range(rng.randrange(80))) for _ in range(400)]
    assert len(decode(spark, noise)) == 400
