"""URL filters: explicit rules by host and path, and association rules over URL tokens for the rest."""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens.llm.common import ascii_lower, written

# (host, path, verdict): fits the host and its subdomains where the path begins with the rule's; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
LABEL = "="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, path segments and parameter names, digits folded to ``#``."""
    folded = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, "[0-9]+", "#")))
    names = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), F.lit(1))
    scheme = F.array(ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))
    return F.sort_array(F.array_distinct(F.concat(folded("s:", scheme), folded("h:", F.split(host, r"\.")), folded("p:", F.split(path, "/")), folded("q:", names))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from (tokens, label): ``antecedent``, ``verdict``, ``confidence``, ``support`` and ``anchor``, the antecedent's rarest token.

    FP-growth counts the frequent combinations over all labelled rows. Rows without a label are ignored; with no labelled
    row there are no rules. The table is written to the shared folder, so later readers do not mine again.
    """
    spark = labelled.sparkSession
    baskets = labelled.filter(F.col("label").isNotNull()).select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, anchor string")
    if baskets.isEmpty():
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(written(baskets, "url-baskets"))
    is_label = lambda x: x.startswith(LABEL)
    rules = model.associationRules.filter(is_label(F.get("consequent", F.lit(0))) & ~F.exists("antecedent", is_label))
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq"))
    rare = (
        rules.select("antecedent", F.substring(F.get("consequent", F.lit(0)), len(LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "support", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    )
    return written(rare, "url-rules")


def merged(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, rep): the frequent tokens of (row, tokens), and for those in exactly the same rows one name, the least of them.

    Tokens that always come together, such as a site's common path, would give every subset of themselves as a rule of its
    own, all with one support and confidence; under one name they are one token. Equal counts and row hashes suggest a
    group, a count of its tokens per row decides: a group that any row holds in part is left as single tokens.
    """
    held = labelled.select("row", F.explode("tokens").alias("token"))
    least = min_support * labelled.count()
    frequent = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("mark")).filter(F.col("n") >= least)
    named = written(frequent.withColumn("rep", F.min("token").over(W.partitionBy("n", "mark"))).select("token", "rep"), "url-tokens")
    sizes = named.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    partly = held.join(named, "token").groupBy("row", "rep").agg(F.count(F.lit(1)).alias("k")).join(sizes, "rep").filter(F.col("k") < F.col("size"))
    broken = partly.select("rep").distinct().withColumn("broken", F.lit(True))
    return named.join(broken, "rep", "left").select("token", F.when(F.col("broken"), F.col("token")).otherwise(F.col("rep")).alias("rep"))


def renamed(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(tokens, reps, sizes) of distinct token sets: the names of their tokens, and how many tokens each name stands for here."""
    held = sets.select("tokens", F.explode("tokens").alias("token")).join(names, "token").groupBy("tokens", "rep").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pairs = held.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("p"))
    return pairs.select("tokens", F.col("p.rep").alias("reps"), F.map_from_entries("p").alias("sizes"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` and the ``verdict`` of the best rule contained in them, or in their ``reps`` where the sets have those.

    Inverted index: a rule is looked up under its rarest token only and its whole antecedent is tested in the join, so
    nothing but rules that hold come out. Best: confidence, then support, then longer antecedent (a name counts for as many
    tokens as it stands for in the set), then ``block``.
    """
    if "reps" not in sets.columns:
        sets = sets.select("tokens", F.col("tokens").alias("reps"), F.map_from_arrays("tokens", F.transform("tokens", lambda _: F.lit(1))).alias("sizes"))
    index = sets.select("tokens", "reps", "sizes", F.explode("reps").alias("anchor")).alias("s")
    holds = (F.col("s.anchor") == F.col("r.anchor")) & (F.size(F.array_except("antecedent", "reps")) == 0)
    length = F.aggregate("antecedent", F.lit(0), lambda n, x: n + F.element_at("sizes", x))
    strength = F.struct("confidence", "support", length.alias("n"), (F.col("verdict") == "block").alias("b"), F.col("verdict"))
    return index.join(rules.alias("r"), holds).groupBy("tokens").agg(F.max(strength)["verdict"].alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """``page`` (struct of the input row), ``host``, ``path``, ``rule``, ``verdict``.

    ``labels`` has ``id`` and ``label`` (verdict). Training rows are the labelled pages with their labels as given;
    explicit rules decide only here. Pages without a fitting rule get the verdict of the best association rule, else ``default``. A null or
    unparsable url has an empty host and path, few or no tokens, and usually the default. Repeated rows repeat their
    verdict; repeated labels of a page all count; null ids have no label. An empty pages table gives an empty one. Other
    columns are only carried inside ``page``. Urls are parsed whole by regular expressions in linear time, however long. Tokens
    that always come together are mined as one (:func:`merged`); frequent tokens that overlap in all other ways still
    combine, so labelled pages with dozens of them each need a higher support.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.select(F.struct("*").alias("page"), F.col(key).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page", "id", "host", "path", rule.alias("rule"), verdict.alias("explicit"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    known = judged.select("id", "tokens").join(labels.filter("label is not null").select("id", "label"), "id").select(F.monotonically_increasing_id().alias("row"), "tokens", "label")
    known = written(known, "url-known")
    names = written(merged(known), "url-names")
    sets = lambda of: renamed(of.select("tokens").distinct(), names)
    mined = mine(known.join(sets(known), "tokens", "left").select(F.coalesce("reps", F.array().cast("array<string>")).alias("tokens"), "label"))
    best = match(sets(judged.filter("explicit is null")), mined)
    return judged.join(best, "tokens", "left").select("page", "host", "path", "rule", F.coalesce("explicit", "verdict", F.lit(default)).alias("verdict"))
