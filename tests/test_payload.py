"""Payload expressions against a byte-level brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import payload as P
from trafficlens.operators import features as FE
from trafficlens.operators import signatures as SG

PIECES = [
    "select", "Union", "from", "WHERE", "table", "drop", "selected", "é", "_", "%27", "'", " --", "--", "#", "/*", "\n", "\r\n",
    "<script", "</script>", ">", "<", "javascript:", "onmouse", "on", "onclick", "=", " = ", "x", ";", "|", "`", "$(", "${", "/etc/",
    "/bin/", "../", "..\\", ".php", ".asp", "aspx", ".jsp", "slowloris", "R-U-Dead-Yet", "botnet", "TROJAN", "password=", "cc=",
    "HTTP/1.1", "http/", "get", "SSH-2.0", "220 a FTP", "220 ", " FTP", " SMTP", "EHLO", "{", "}", " ", "<?xml", "a1", "\x00\x01",
    "\x00\x00\x01\x00\x00\x01", "ÿ", "þ", "\x16\x03\x01", "230 Login successful", "\t", "\x0b", "\x85", "ß",
]


def texts():
    rng = random.Random(11)
    fixed = [
        "", None, " ", "aaaa", "é", "admin'", "admin'\n", "' \n--", "' OR 1=1 --", "admin' --", "select\nx\nfrom", "éselect from",
        "select fromé", "1select from", "GET / HTTP/1.1", "\x16\x03\x01", "{\"a\": 1}\n", " <a>", "220 x\nFTP", "=a\n../b.php", "=../x.php",
        "plain words here", "<a onclick = 1>", "<p>one</p> = ", "..\\", "x" * 50 + "é" * 60,
    ]
    return fixed + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]


@pytest.fixture(scope="module")
def analysed(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "packet_id bigint, payload string")
    return dict(rows), {r["packet_id"]: r for r in FE.payload_analysis(df).collect()}


def test_signatures_equal_the_plain_patterns(analysed):
    given, got = analysed
    patterns = {
        n: re.compile(p.encode("latin-1"), re.I | (re.S if n in dims.MULTILINE_SIGNATURES else 0))
        for n, p in dims.ATTACK_SIGNATURES.items()
    }
    hits = Counter()
    for key, text in given.items():
        data = (text or "").encode("utf-8")
        want = [n for n, p in patterns.items() if data and p.search(data)]
        hits.update(want)
        assert got[key]["detections"] == want, repr(text)
    assert all(hits[n] > 5 for n in patterns)


def test_content_type_equals_the_plain_patterns(analysed):
    given, got = analysed
    flags = {"i": re.I, "s": re.S}
    patterns = {n: re.compile(p.encode("latin-1"), flags[f]) for n, (f, p) in dims.CONTENT_PATTERNS.items()}
    seen = set()
    for key, text in given.items():
        data = (text or "").encode("utf-8")
        want = "unknown"
        if data:
            share = sum(32 <= b <= 126 for b in data) / len(data)
            want = next((n for n, p in patterns.items() if p.search(data)), "text" if share > 0.8 else "binary")
        seen.add(want)
        assert got[key]["content_type"] == want, repr(text)
    assert seen == set(patterns) | {"text", "binary", "unknown"}


def test_statistics_equal_a_byte_count(analysed):
    given, got = analysed
    for key, text in given.items():
        data = (text or "").encode("utf-8")
        row, counts = got[key], Counter(data)
        assert row["payload_size"] == len(data)
        if not data:
            assert row["entropy"] == 0.0 and row["printable_ratio"] == 0.0 and row["byte_frequency"] is None
            continue
        entropy = -sum(c / len(data) * math.log2(c / len(data)) for c in counts.values())
        assert abs(row["entropy"] - entropy) < 1e-9 and 0 <= row["entropy"] + 1e-12 <= 8
        assert abs(row["printable_ratio"] - sum(32 <= b <= 126 for b in data) / len(data)) < 1e-12
        top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        assert row["byte_frequency"] == {hex(b): n / len(data) for b, n in top}


def test_user_patterns_follow_byte_semantics(spark):
    df = spark.createDataFrame([(1, "éword"), (2, "word"), (3, "a\nWORD"), (4, "words")], "packet_id bigint, payload string")
    rules = spark.createDataFrame([("edge", r"\bword\b"), ("end", r"word\Z"), ("span", "a.w")], "name string, pattern string")
    want = [(1, "edge"), (1, "end"), (2, "edge"), (2, "end"), (3, "edge"), (3, "end"), (3, "span")]
    assert sorted(map(tuple, SG.matches(df, rules, include_builtin=False).collect())) == want
    many = spark.range(700).select(F.concat(F.lit("none"), "id").alias("name"), F.concat(F.lit("zz"), "id").alias("pattern"))
    assert sorted(map(tuple, SG.matches(df, rules.unionByName(many), include_builtin=False).collect())) == want


def test_line_ends_groups_and_classes(spark):
    texts = ["foo", "foo\n", "foo\r\n", "foo\r", "foo\x85", "abab", "a\x08b", "[x]", "&&", "foo\n\n"]
    patterns = ["foo$", r"(?P<p>ab)(?P=p)", r"[\b]", r"[[x]]", r"[&&]", r"[]x]", r"\Afoo\Z"]
    df = spark.createDataFrame(list(enumerate(texts)), "packet_id bigint, payload string")
    rules = spark.createDataFrame([(p, p) for p in patterns], "name string, pattern string")
    # Payloads are matched as UTF-8 bytes, user patterns ignore case and let a dot span lines.
    want = [(i, p) for i, t in enumerate(texts) for p in patterns if re.search(p.encode(), t.encode(), re.I | re.S)]
    assert sorted(map(tuple, SG.matches(df, rules, include_builtin=False).collect())) == sorted(want)


def test_one_rule_for_names(spark):
    """The newest pattern of a name counts, and a user signature replaces a built-in one, for any number of rules."""
    df = spark.createDataFrame([(1, "<script>v1</script>"), (2, "v2")], "packet_id bigint, payload string")
    rules = [("xss", "nothing", 1, None), ("v", "v1", 1, None), ("v", "v2", 2, None)]
    for extra in (0, 400):
        more = spark.createDataFrame(rules + [(f"n{i}", f"zz{i}", 9, None) for i in range(extra)], "name string, pattern string, id bigint, updated_at timestamp")
        assert sorted(map(tuple, SG.matches(df, more).collect())) == [(2, "v")]


def test_many_signatures_need_no_join(spark, folder):
    from trafficlens.sources import views as V

    many = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("zz"), "id").alias("pattern"))
    text = SG.matches(V.packets(spark, folder), many)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text


def test_structured_and_binary_payloads(spark):
    df = spark.sql("select 1L as packet_id, named_struct('cmd', 'botnet') as payload")
    row = FE.payload_analysis(df).first()
    assert (row["content_type"], row["detections"]) == ("json", ["malware_communication"])
    row = FE.payload_analysis(spark.sql("select 1L as packet_id, X'160301FF' as payload")).first()
    assert (row["content_type"], row["payload_size"]) == ("ssl", 4)


def test_inspection_off_gives_zeros(spark, folder):
    from trafficlens.sources import views as V

    v = FE.feature_vectors(V.packets(spark, folder), dpi=False)
    bad = v.filter(F.exists(F.slice("features", 16, 20), lambda x: x != 0) | (F.size("features") != 35))
    assert bad.count() == 0


def test_pattern_rewriting_keeps_escaped_backslashes():
    assert P.java_regex(r"a\\Z", "is") == r"(?isd)a\\Z"
    assert P.java_regex(r"a\Z", "i") == r"(?id)a\z"
