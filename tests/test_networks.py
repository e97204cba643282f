"""Longest-prefix lookup against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from trafficlens.operators import networks as N


def text_of(net):
    return str(net)


def test_longest_prefix_agrees_with_the_standard_library(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network((rng.choice([10 << 24, 172 << 24, 0xC0A80000]) + rng.randrange(1 << rng.choice([4, 12, 24])), rng.randrange(33)), strict=False) for _ in range(400)]
    base6 = int(ipaddress.ip_address("2001:db8::"))
    nets += [ipaddress.ip_network((base6 + (rng.randrange(1 << 20) << rng.choice([0, 44, 64, 90])), rng.choice([0, 1, 32, 63, 64, 65, 96, 127, 128, rng.randrange(129)])), strict=False) for _ in range(400)]
    ips = [n.network_address + rng.randrange(min(n.num_addresses, 1 << 20)) for n in nets]
    ips += [ipaddress.ip_address(rng.randrange(1 << 32)) for _ in range(200)] + [ipaddress.IPv6Address(rng.randrange(1 << 128)) for _ in range(200)]
    table = spark.createDataFrame([(str(n), f"n{k:04}") for k, n in enumerate(nets)], "network string, label string")
    df = spark.createDataFrame([(k, str(ip)) for k, ip in enumerate(ips)], "k int, ip string")
    got = {r["k"]: (r["network_label"], r["network_bits"]) for r in N.lookup(df, "ip", table).collect()}
    assert len(got) == len(ips)
    for k, ip in enumerate(ips):
        fits = [(-n.prefixlen, f"n{j:04}") for j, n in enumerate(nets) if n.version == ip.version and ip in n]
        bits, label = min(fits, default=(None, None))
        assert got[k] == (label, bits and -bits if fits else None) or (bits == 0 and got[k] == (label, 0)), ip


def test_malformed_and_repeated_rows(spark):
    rows = [("10.0.0.0/8", "b"), ("10.9.9.9/8", "a"), ("10.0.0.1", "one"), ("10.0.0.0/33", "x"), ("10.0.0.0/", "x"), ("10.0.0/8", "x"), (None, "x"), ("::1/129", "x"), ("10.0.0.0/8/9", "x"), ("::/0", "six")]
    table = spark.createDataFrame(rows, "network string, label string")
    assert sorted((r["version"], r["prefix"], r["label"]) for r in N.parsed(table).collect()) == [(4, 8, "a"), (4, 32, "one"), (6, 0, "six")]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(["10.0.0.1", "10.0.0.1", "10.1.1.1", "11.0.0.0", None, "bad", "::ffff:10.0.0.1", ""])], "k int, ip string")
    got = [r["network_label"] for r in N.lookup(df, "ip", table).orderBy("k").collect()]
    assert got == ["one", "one", "a", None, None, None, "six", None]
    empty = N.lookup(df, "ip", table.limit(0))
    assert empty.filter("network_label is null").count() == 8


def test_no_nested_loop(spark):
    table = spark.createDataFrame([("10.0.0.0/8", "a")], "network string, label string")
    df = spark.range(10).select(F.concat(F.lit("10.0.0."), "id").alias("ip"))
    plan = N.lookup(df, "ip", table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
