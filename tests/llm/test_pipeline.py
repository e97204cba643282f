"""Every stage of the pipeline on all its predecessor kept, against plain versions."""

import struct
import zlib
from collections import Counter

import brute
import corpus_pipeline
import pytest

from trafficlens.llm import decontamination, mixing, quality_model, simhash, tokens
from trafficlens.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, out = table(spark, folder, "documents"), [table(spark, folder, "documents").collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def windows(text):
    import re

    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    return {tuple(ws[i : i + 10]) for i in range(max(len(ws) - 9, 1))} if ws else set()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "mix", "tokens"]


def test_columns_stay(stages):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[:5])


def test_quality_keeps_good_documents(spark, stages):
    quality = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.001", "labels").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert all(i in kept for i, q in quality.items() if q == 1)
    assert sum(i in kept for i, q in quality.items() if q == 0) <= 0.2 * sum(q == 0 for q in quality.values())
    assert set(stages[1]) <= set(stages[0])


def test_one_document_of_each_group(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    roots = brute.components([brute.fingerprint(r["text"]) for r in rows])
    assert sorted(stages[2]) == sorted(rows[i] for i in set(roots))


def test_no_benchmark_window_stays(spark, stages):
    bench = set().union(*(windows(r["text"]) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()))
    assert min(map(len, bench)) == 10
    assert sorted(stages[3]) == sorted(r for r in stages[2] if not windows(r["text"]) & bench)


def targets(sizes):
    """{source: target} with targets cut at three sizes and the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, total, cut = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = sum(w for s, w in weight.items() if s not in cut)
        level = (total - sum(3 * sizes[s] for s in cut)) / left if left else 0
        more = {s for s in order if s not in cut and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in cut else weight[s] * level for s in order}
        cut |= more


def test_mix_meets_targets(stages):
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in stages[3]}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in stages[4]:
        taken[r["source"]] += size[r["doc_id"]]
    want = targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 3
    assert set(stages[4]) <= set(stages[3])


def test_tokens_of_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer, want, start = Tokenizer.from_file(tokens.default_tokenizer()), [], 0
    for r in sorted(stages[4], key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in stages[5]) == want


def test_whole_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[5]))


CLASHING = "doc_id long, text string, source string, row long, doc string, score double, fp long, w string, size long, key string, rank int, spans string, kept boolean"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "d", 0.5, 2, "w", 3, "k", 4, "s", True) for i, t, s in rows], CLASHING)


ROWS = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, None, None), (None, "word " * 30, None), (2, "", "x"), (3, None, "y"), (4, " \n ", "y"), (5, "q " * 5000, "z"), (6, "q " * 5000, "z")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_filters_keep_columns_of_any_name(spark, rows):
    """Nulls, empty and blank texts, repeated rows, an empty table, and columns named like the operators' own."""
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(7, "word word"), (None, None), (8, "q " * 12), (9, "")], "item_id long, text string")
    none = quality_model.Model(0.9)
    assert quality_model.accepted(docs, none).columns == docs.columns
    assert quality_model.accepted(docs, none).count() == len(rows)
    groups = simhash.deduplicated(docs)
    assert groups.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in groups.collect()} == ({(1, "a b c d e f"), (None, "word " * 30), (2, ""), (5, "q " * 5000)} if rows else set())
    assert groups.count() == (4 if rows else 0)
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r["text"])[:4] for r in clean.collect()) == sorted(str(t)[:4] for _, t, _ in rows if not (t or "").startswith(("word", "q")))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and all(0 <= r["copies"] <= 3 for r in taken)
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    none = spark.createDataFrame([], "id long, label int")
    assert quality_model.fit(docs, none).weights is None
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "id long, label int")
    assert quality_model.fit(docs, one).prior == pytest.approx(3 / 4)
