"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and columns named like the operators' own."""

import glob
import os

import brute
import duckdb
import pytest
from check_queries import rows_of
from pyspark.sql import functions as F

from trafficlens.llm import decontamination, language_model, mixing, quality_model, quality_rules, queries, repeated_spans, secrets, simhash, tokens, url_filters
from trafficlens.llm.common import table

NAMES = "row long, doc string, id string, score double, fp long, w string, size long, key string, rank int, spans string, kept boolean, block long, bucket int, pair string, least int, n_words int, host string, path string, label string, source string"
LONG = "pass " * 30_000 + "password = 'abcdefghij' " + "z" * 200_000
ROWS = [(1, "a b c d e"), (1, "a b c d e"), (None, None), (None, "x y"), (2, ""), (3, None), (4, " \n\t "), (5, LONG), (6, LONG), (7, "é" * 60), (0, "é" * 60)]


def docs_of(spark, rows):
    extra = (1, "d", "i", 0.5, 2, "w", 3, "k", 4, "s", True, 5, 6, "p", 7, 8, "h", "p", "l", "src")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {NAMES}")


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    return docs_of(spark, ROWS if request.param == "rows" else [])


def test_near_duplicates(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    if got:
        by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
        assert by[(2, 0)] == by[(3, 0)] == by[(4, 0)] == by[(None, 0)] == 2
        assert {c for (i, _), c in by.items() if i in (5, 6)} == {5} and {c for (i, _), c in by.items() if i in (0, 7)} == {0}


def test_repeated_spans(docs):
    got = repeated_spans.spans(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        size = len((dict(ROWS).get(r["doc_id"]) or "").encode())
        removed = {6: size, 7: 120}.get(r["doc_id"], 0)
        # A long text repeats itself, which does not count.
        assert r["n_removed"] == removed and (r["removed"] == [(0, removed)] if removed else r["removed"] == [])


def test_language_model(docs):
    got = language_model.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    assert len(got) == docs.count()
    want = {i: (h, n, k) for i, h, n, k, _, _ in brute.unigrams(ROWS) if i is not None}
    assert all((r["held_out"], r["n_tokens"], r["n_known"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_token_files(docs):
    got = tokens.encode_documents(docs, tokens.default_tokenizer()).collect()
    assert len(got) == docs.count()
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(len(got))]
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (2, 3, 4))


def test_secret_scan(docs):
    got = secrets.scan(docs).collect()
    assert len(got) == docs.count()
    assert all([s["kind"] for s in r["spans"]] == (["assign"] if r["doc_id"] in (5, 6) else []) for r in got)


def test_quality_rules(docs):
    got = quality_rules.judge(docs)
    assert quality_rules.filtered(docs).columns == docs.columns
    assert all(r["base_failed"] and not r["kept"] for r in got.collect() if r["doc"]["doc_id"] != 5) and got.count() == docs.count()


def test_quality_scores(docs):
    rows = [("good words are here " * 2000).encode(), b"!! ### $$$" * 30, b""]
    import numpy as np
    import zstandard

    model = quality_model.train([zstandard.compress(r) for r in rows], np.array([1, 0, 1]), np.ones(3), 0.5, steps=50)
    assert model.score(rows) == pytest.approx([model.score([r])[0] for r in rows], abs=1e-6)
    got = quality_model.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_quality_of_a_very_long_text():
    """Memory follows the pieces, not the text."""
    import tracemalloc

    import numpy as np
    import zstandard

    model = quality_model.train([zstandard.compress(r) for r in (b"fine words " * 300, b"$$ ## " * 300)], np.array([1, 0]), np.ones(2), 0.5, steps=50)
    text = b"fine words, all of them. " * 800_000
    tracemalloc.start()
    score = model.score([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and score == pytest.approx(model.score([text[: 1 << 20]]), abs=0.02)


def test_mixing_is_the_same_again(docs):
    once, again = (sorted((r["doc"]["doc_id"] or -1, r["copies"], r["target"]) for r in mixing.mix(docs).collect()) for _ in range(2))
    assert once == again and len(once) == docs.count()


def test_mixing_agrees_for_any_order_of_rows_of_one_id(spark):
    rows = [(7 if k % 3 else None, f"w{k} x", s) for k in range(90) for s in ("a", "b")] + [(k, f"v{k} y z", "b") for k in range(40)]
    taken = []
    for order, parts in ((rows, 1), (rows[::-1], 5)):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts, "text")
        taken.append(sorted((r["text"], r["source"]) for r in mixing.mixed(df).collect()))
    assert taken[0] == taken[1] and len(taken[0]) > len(set(taken[0]))


def test_overlaps_with_short_items(spark, docs):
    bench = spark.createDataFrame([(1, "B c"), (2, "e"), (3, ""), (4, None), (None, "pass " * 12), (5, "d e f")], "item_id long, text string")
    found = decontamination.overlaps(docs.select(F.struct(F.monotonically_increasing_id().alias("n"), "doc_id").alias("row"), "text"), bench).collect()
    assert len(found) == docs.count()
    for r in found:
        want = {1: (5, 3, ["1", "2"]), 5: (30_003, 30_000, [""]), 6: (30_003, 30_000, [""])}.get(r["row"]["doc_id"])
        if want:
            assert (r["n_words"], r["n_hit"], r["items"]) == want
        else:
            assert r["n_hit"] == 0 and r["items"] == []


def test_overlaps_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_KEYS", 40)
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row"), "text")
    bench = table(spark, folder, "benchmark")
    split = sorted((r["row"], r["n_hit"], r["items"]) for r in decontamination.overlaps(rows, bench).collect())
    monkeypatch.undo()
    assert split == sorted((r["row"], r["n_hit"], r["items"]) for r in decontamination.overlaps(rows, bench).collect())
    assert any(n for _, n, _ in split)


def test_urls(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    none = spark.createDataFrame([], "id long, label string")
    got = url_filters.judge(pages, none).collect()
    assert len(got) == docs.count() and all((r["host"], r["path"], r["rule"], r["verdict"]) == ("", "", None, "allow") for r in got)


def test_native_operators_run_no_python(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("op2_decontamination", "op10_quality_rules"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, result = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
