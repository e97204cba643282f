import ipaddress
import random

from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import address as A


def test_private_ranges_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    numbers = {rng.randrange(2**32) for _ in range(4000)}
    for n in map(ipaddress.ip_network, dims.PRIVATE_NETWORKS):
        lo, hi = int(n.network_address), int(n.broadcast_address)
        numbers |= {x for x in (lo - 1, lo, lo + 1, hi - 1, hi, hi + 1) if 0 <= x < 2**32}
    numbers |= {int(ipaddress.ip_address(a)) + d for a in dims.GLOBAL_EXCEPTIONS for d in (-1, 0, 1)}
    texts = [str(ipaddress.ip_address(n)) for n in numbers]
    df = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", A.is_private(F.col("ip")).alias("p"))
    for ip, private in df.collect():
        assert private == ipaddress.ip_address(ip).is_private, ip


def test_public_and_edge_cases(spark):
    cases = {
        "203.0.113.7": False, "100.64.0.1": True, "172.31.0.1": False, "172.32.0.1": True, "192.0.0.9": True,
        "192.0.0.8": False, "not-an-ip": False, "8.8.8.8": True, "8.8.8": False, "08.8.8.8": False, "8.8.8.8\n": False,
        "256.1.1.1": False, None: False, "": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "ip string, want boolean")
    for ip, want, got in df.select("ip", "want", A.is_public(F.col("ip"))).collect():
        assert want == got, ip


def test_ipv6_agrees_with_the_standard_library(spark):
    rng = random.Random(9)
    numbers = {rng.randrange(2**128) for _ in range(500)} | {0, 1, 2, 2**128 - 1}
    numbers |= {(0xFFFF << 32) | rng.randrange(2**32) for _ in range(200)} | {(0xFFFF << 32) | 0x08080808}
    for n in map(ipaddress.ip_network, dims.PRIVATE_NETWORKS_V6 + dims.GLOBAL_NETWORKS_V6):
        lo, hi = int(n.network_address), int(n.broadcast_address)
        numbers |= {x for x in (lo - 1, lo, lo + 1, hi - 1, hi, hi + 1) if 0 <= x < 2**128}
    texts = set()
    for n in numbers:
        a = ipaddress.IPv6Address(n)
        texts |= {a.compressed, a.exploded, a.compressed.upper()}
    texts |= {"1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "2606:4700::1111"}
    bad = {"1:2:3:4:5:6:7:8::", ":::", "1::2::3", "12345::", ":1:2", "1:2:3", "g::1", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.256", ":", "1:2:3:4::5:6:7:8"}
    df = spark.createDataFrame([(t,) for t in sorted(texts | bad)], "ip string")
    for ip, private, public in df.select("ip", A.is_private(F.col("ip")), A.is_public(F.col("ip"))).collect():
        if ip in bad:
            assert (private, public) == (False, False), ip
        else:
            want = ipaddress.ip_address(ip).is_private
            assert (private, public) == (want, not want), ip


def test_zones_and_direction(spark):
    df = spark.createDataFrame([("192.168.1.5", "1.192.168.5"), ("10.1.1.1", "172.16.0.1"), (None, "8.8.8.8")], "a string, b string")
    out = df.select(A.host_zone(F.col("a")), A.host_zone(F.col("b")), A.direction(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [
        ("internal", "external", "internal_to_external"),
        ("external", "dmz", "internal_to_internal"),
        ("external", "external", "external_to_external"),
    ]
