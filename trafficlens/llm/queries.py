"""The named queries of the training-data operators and the SQL texts they are checked against."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import (
    decontamination, language_id, language_model, lexical_search, mixing, periodic_runs, quality_model, quality_rules, repeated_spans, secrets, simhash, tokens,
    url_filters,
)
from trafficlens.llm.common import let, table, words

WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label) of the rows that may teach."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return labels.filter(F.crc32(F.col("id").cast("string")) % 4 != 2)


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_model.fit(docs.select(F.col("doc_id").alias("id"), "text"), quality_labels(spark, sf))
    held_out = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return quality_model.scored(docs, model).select(
        "doc.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted")
    )


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.struct(F.monotonically_increasing_id().alias("n"), "doc_id").alias("row"), "text")
    found = decontamination.overlaps(docs, table(spark, sf, "benchmark").select("item_id", "text"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
OP2 = f"""with docs as (select row_number() over () as r, doc_id, {BENCH_WORDS} as w from documents),
items as (select item_id, {BENCH_WORDS} as w from benchmark),
cut as (select distinct coalesce(cast(item_id as varchar), '') as item, array_to_string(w[i : i + 9], ' ') as g, least(len(w), 10) as n from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0) a),
spots as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from cut) l where len(w) >= n) b),
found as (select r, i, spots.n, item from spots join cut using (g, n)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) c group by r),
named as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)"""


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(bad, "block").otherwise("allow").alias("label"))
    judged = url_filters.judge(table(spark, sf, "pages").select("page_id", "url"), labels)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op4_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf, "documents").select("doc_id", "text"), tokens.default_tokenizer())


def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return language_model.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op7_repeated_spans(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_spans.spans(table(spark, sf, "documents").select("doc_id", "text")).drop("removed")


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op9_mixing_sources(spark: SparkSession, sf: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mix.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP9 = rf"""with docs as (select doc_id, source, coalesce('s' || source, '') as skey, cast(len({WORDS_SQL.format(text="coalesce(text, '')")}) as bigint) as size,
 md5(coalesce(cast(doc_id as varchar), text, '')) as key from documents),
sources as (select *, row_number() over (order by source nulls last) as pos from (select skey, source, cast(sum(size) as bigint) as source_size from docs group by all) a),
weighed as (select *, 1 + (pos - 1) % 3 as weight, 3 * source_size as cap, sum(source_size) over () as total from sources),
filled as (select *, coalesce(sum(cap) over w, 0) as cut, sum(weight) over (order by cap / cast(weight as double) desc, skey desc) as rest from weighed
 window w as (order by cap / cast(weight as double), skey rows between unbounded preceding and 1 preceding)),
water as (select max(cast(total - cut as double) / cast(rest as double)) filter (cast(total - cut as double) / cast(rest as double) <= cap / cast(weight as double)) as l from filled),
shares as (select skey, source_size, least(weight * l, cast(cap as double)) as target, case when source_size > 0 then least(weight * l, cast(cap as double)) / source_size else 0 end as rate,
 cast('0x' || substr(md5(skey), 1, 8) as bigint) / 4294967296.0::double as off from weighed, water),
ranked as (select *, row_number() over (partition by skey order by size, key) as upto from docs)
select doc_id, size, source_size, target, cast(size * least(greatest(floor(rate * upto + off) - floor(rate * (upto - 1) + off), 0), 3) as bigint) as taken
from ranked join shares using (skey)"""


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS.split())))
OP10 = rf"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {WORDS_SQL.format(text="coalesce(text, '')")} as w from documents),
grams as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from docs) a),
repeats as (select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, g) as n from grams) b where n > 1),
repeated as (select r, count(distinct p) as n_repeat_words from repeats group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as l from docs) c where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
stops as (select r, count(*) as n_stop from (select r, unnest(w) as x from docs) d where lower(regexp_replace(x, '[^\p{{L}}]+$', '')) in ({STOP_SQL}) group by r),
counted as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, length(t) - length(replace(t, '!', '')) as n_ex,
 cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_lines, 0) as n_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(n_stop, 0) as n_stop
 from docs left join repeated using (r) left join lines using (r) left join stops using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars >= 2 * n_words and word_chars <= 20 * n_words and 10 * n_symbols <= word_chars
 and 5 * n_ex <= n_words and 50 * n_stop >= n_words and 2 * n_dup_lines <= greatest(n_lines, 1) as kept from counted"""


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = lambda i: F.coalesce(F.crc32(F.col(i).cast("string")) % 5 == 0, F.lit(False))
    network = language_id.fit(docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    judged = language_id.predicted(docs.select("doc_id", "text"), network)
    return judged.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP12 = f"""with docs as (select row_number() over () as r, doc_id, {BENCH_WORDS} as w from documents),
items as (select row_number() over () as i, item_id, {BENCH_WORDS} as w from benchmark),
asked as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(w) as term from items) a group by all),
held as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from docs) b where term in (select term from asked) group by all),
counts as (select count(*) as nd, cast(sum(len(w)) as bigint) as l from docs where len(w) > 0),
weights as (select term, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * count(*) + 1))) as bigint) as wt from held, counts group by term, nd),
scored as (select i, item_id, r, doc_id, cast(sum(times * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) as bigint) as score
 from asked join held using (term) join weights using (term), counts group by i, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10"""


def looped(doc_id: Column, text: Column) -> Column:
    """The contract's text of a document: of one id hash in ten the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        return let((g % n).cast("int"), lambda a: let((1 + F.floor((n - a) / (3 + g % 8))).cast("int"), lambda p: F.array_join(
            F.concat(F.slice(w, F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))), " ")))

    return F.when(h % 10 == 0, let(words(text), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.collapsed(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.select("doc.doc_id", "runs", "collapsed", longest.alias("longest"), lines.alias("lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), "longest.length", (-F.col("longest.short")).alias("period"),
        F.floor(F.lit(1000) * F.col("longest.length") / -F.col("longest.short")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_secret_scan": op8_secret_scan,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op9_mixing_sources": OP9, "op10_quality_rules": OP10, "op12_lexical_search": OP12}
