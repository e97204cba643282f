"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import let, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on was with as be by this are from at or an he not have "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es für "
    "le la les de des et en un une du que qui dans est pour pas sur au par plus ne se "
    "el los las y del una con por para como su al lo más o pero sus"
)


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose ``metric`` lies within [least, most]; an open end is None."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", least=50),
    Rule("repeat_word_ratio", most=0.5),
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.1),
    Rule("exclamation_ratio", most=0.2),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
)
BASE = ("n_words", "repeat_word_ratio")


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows found twice or more. Hashes tell texts without repeats apart; the rest compares the words themselves."""

    def counted(w):
        last = F.greatest(F.size(w) - 2, F.lit(0))
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), last)
        windows = F.slice(F.transform(w, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))), F.lit(1), last)

        def covered(s):
            same = lambda x, k: F.coalesce(x["s"] == F.get(s, k)["s"], F.lit(False))
            starts = F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == last, F.lit(0)).otherwise(let(F.sort_array(windows), covered))

    return let(ws, counted)


def characters(text: Column, chars: str) -> Column:
    """How many of ``chars`` a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the input row) and its counts and ratios."""
    whole = F.coalesce(F.col(text), F.lit(""))
    stop = sorted(set(STOP_WORDS.split()))
    counts = docs.select(F.struct("*").alias("doc"), whole.alias("t"), words(F.col(text)).alias("w")).select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        characters(F.col("t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        characters(F.col("t"), "!").alias("n_exclamations"),
        let(F.filter(F.split("t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""), lambda x: F.array(F.size(x), F.size(F.array_distinct(x)))).alias("lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]+$", "")).isin(stop))).alias("n_stop_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "doc", "n_words", "word_chars", "n_symbols", (F.get("lines", F.lit(0)) - F.get("lines", F.lit(1))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("n_exclamations") / n).alias("exclamation_ratio"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
        ((F.get("lines", F.lit(0)) - F.get("lines", F.lit(1))) / F.greatest(F.get("lines", F.lit(0)), F.lit(1))).alias("dup_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where no rule fails."""
    tests = [F.col(r.metric) >= r.least for r in rules if r.least is not None] + [F.col(r.metric) <= r.most for r in rules if r.most is not None]
    passed = F.lit(True)
    for t in tests:
        passed = passed & t
    return passed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``doc`` (struct of the input row), its metrics, ``base_failed`` and ``kept``.

    One projection, no shuffle. A null or empty text counts no words and fails the length rule; every row is judged on
    its own, so repeated rows repeat their verdict and an empty table gives an empty one. Columns beside the text are
    only carried inside ``doc``, so their names cannot clash.
    """
    base = tuple(r for r in rules if r.metric in BASE)
    return measured(docs, text).withColumn("base_failed", ~compiled(base)).withColumn("kept", compiled(rules))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input rows that pass every rule, columns unchanged."""
    return judge(docs, rules, text).filter("kept").select("doc.*")
