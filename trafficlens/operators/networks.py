"""Networks of addresses from a table of any size: the longest prefix wins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import address


def number(ip: Column) -> Column:
    """``version`` (4 or 6) and the address as two signed 64-bit halves ``hi`` and ``lo``; NULL for malformed text.

    An IPv4 address lies in the low half. IPv6 text may end in a dotted IPv4 address; it stays an IPv6 address.
    """
    octets = F.split(ip, r"\.")
    v4 = sum((F.get(octets, F.lit(i)).cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    parts = lambda version, hi, lo: F.struct(F.lit(version).alias("version"), hi.alias("hi"), lo.alias("lo"))
    # Lambdas keep the long IPv6 expression out of the code generated for every address, and compute it once.
    digits = F.transform(F.array(ip), address.ipv6_digits)
    half = lambda d, at: F.conv(F.substring(d, at, 16), 16, -10).cast("bigint")
    v6 = F.get(F.transform(digits, lambda d: F.when(d.isNotNull(), parts(6, half(d, 1), half(d, 17)))), F.lit(0))
    return F.when(ip.contains(":"), v6).when(address.is_ipv4(ip), parts(4, F.lit(0).cast("bigint"), v4))


def _numbered(ip: Column) -> Column:
    """:func:`number` as a column of its own, of the rows that have one: an exploded value is computed once, however often it is used."""
    return F.explode(F.array_compact(F.array(number(ip)))).alias("_at")


def _leading(value: Column, dropped: Column) -> Column:
    """``value`` with its last ``dropped`` bits zero, for 0 to 64 of them."""
    cut = F.call_function("shiftleft", F.call_function("shiftrightunsigned", value, dropped), dropped)
    return F.when(dropped >= 64, F.lit(0).cast("bigint")).otherwise(cut)


def masked(at: Column, prefix: Column) -> tuple[Column, Column]:
    """Both halves of an address of :func:`number` with the bits behind the prefix zero."""
    v4 = at["version"] == 4
    hi = F.when(v4, at["hi"]).otherwise(_leading(at["hi"], F.greatest(64 - prefix, F.lit(0))))
    lo = _leading(at["lo"], F.when(v4, 32 - prefix).otherwise(F.least(128 - prefix, F.lit(64))))
    return hi, lo


def parsed(networks: DataFrame, network: str = "network", label: str = "label") -> DataFrame:
    """One row per network: ``version``, ``prefix``, ``hi``, ``lo``, ``label``.

    Text is ``address/bits``, or an address for itself alone; bits of the host are ignored. Malformed rows are left out; of
    several labels of one network the smallest counts.
    """
    text = F.col(network)
    rows = networks.select(text.alias("_text"), F.col(label).alias("label"), _numbered(F.split_part(text, F.lit("/"), F.lit(1))))
    whole = F.when(F.col("_at.version") == 4, 32).otherwise(128)
    bits = F.when(F.col("_text").contains("/"), F.when(F.split_part("_text", F.lit("/"), F.lit(2)).rlike(r"\A[0-9]{1,3}\z"), F.split_part("_text", F.lit("/"), F.lit(2)).cast("int"))).otherwise(whole)
    good = rows.withColumn("prefix", bits).filter((F.col("prefix") <= whole) & (F.size(F.split("_text", "/")) <= 2))
    hi, lo = masked(F.col("_at"), F.col("prefix"))
    return good.groupBy(F.col("_at.version").alias("version"), "prefix", hi.alias("hi"), lo.alias("lo")).agg(F.min("label").alias("label"))


def lookup(df: DataFrame, ip: str, networks: DataFrame, network: str = "network", label: str = "label", into: str = "network_label", bits: str = "network_bits") -> DataFrame:
    """``df`` with the label and prefix length of the smallest network that holds its address; NULL where none does.

    Every distinct address is looked up once under each prefix length that the table has (33 and 129 at most), by an equi-join
    on the leading bits, so the work grows with addresses and networks, not with their product. The join back to the rows
    is by the address; Spark splits hot addresses there.
    """
    table = parsed(networks, network, label)
    lengths = {4: [], 6: []}
    for r in table.select("version", "prefix").distinct().collect():
        lengths[r["version"]].append(r["prefix"])
    tried = lambda version: F.array(*map(F.lit, sorted(lengths[version]))).cast("array<int>")
    seen = df.select(F.col(ip).alias("_ip")).distinct().select("_ip", _numbered(F.col("_ip")))
    spread = seen.select("_ip", "_at", F.explode(F.when(F.col("_at.version") == 4, tried(4)).otherwise(tried(6))).alias("prefix"))
    hi, lo = masked(F.col("_at"), F.col("prefix"))
    asked = spread.select("_ip", F.col("_at.version").alias("version"), "prefix", hi.alias("hi"), lo.alias("lo"))
    found = asked.join(table, ["version", "prefix", "hi", "lo"]).groupBy("_ip").agg(F.max_by("label", "prefix").alias(into), F.max("prefix").alias(bits))
    return df.join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")
