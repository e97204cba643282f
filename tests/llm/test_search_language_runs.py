"""Language ID, ranked search and periodic runs against plain versions, on the smallest tables and on awkward rows."""

import random
import zlib
from bisect import bisect_left

import brute
import numpy as np
import pytest
from test_edges import ROWS, docs_of

from trafficlens.llm import language_id, lexical_search, periodic_runs, queries
from trafficlens.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    return docs_of(spark, ROWS if request.param == "rows" else [])


# Periodic runs


def test_runs_of_small_words():
    rnd = random.Random(4)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randrange(1, 5)):
            ws = [rnd.choice([b"a", b"b", b"c"][: rnd.randrange(1, 4)]) for _ in range(rnd.randrange(60))]
            if rnd.random() < 0.3:
                ws = [b"a", b"b"] * rnd.randrange(10) + [b"a", b"c"] * rnd.randrange(10)
            texts.append(ws)
        assert periodic_runs.runs_of(texts) == [brute.runs(ws) for ws in texts]


def test_runs_of_named_cases():
    runs = lambda text: periodic_runs.runs_of([text.encode().split()])[0]
    assert runs("x x x x x") == [] and runs("x x x x x x") == [(0, 6, 1)]
    assert runs("a b a b a b a") == [] and runs("a b a b a b a b") == [(0, 8, 2)]
    assert runs("z a b a b a b a b a y") == [(1, 9, 2)]
    assert runs("x x x x x x y y y y y y") == [(0, 6, 1), (6, 6, 1)]
    inner = "a a a a a a b " * 4
    assert runs(inner) == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]


def test_positions_in_many_chunks():
    rnd, inserted = random.Random(1), [5000]
    own = periodic_runs.Positions(5000)
    for p in rnd.sample([p for p in range(10_000) if p != 5000], 6000):
        k = bisect_left(inserted, p)
        assert own.add(p) == (inserted[k - 1] if k else -1, inserted[k] if k < len(inserted) else -1)
        inserted.insert(k, p)
    assert list(own) == inserted and own.size == len(inserted) and len(own.chunks) > 4


def test_runs_of_long_texts():
    ws = [b"w%d" % (i % 5) for i in range(60_000)]
    assert periodic_runs.runs_of([ws, [b"w%d" % i for i in range(60_000)]]) == [[(0, 60_000, 5)], []]


def test_periodic_query(spark):
    want = {r["doc_id"]: brute.periodic(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    got = queries.op13_periodic_runs(spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = got.collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    assert any(n for n, *_ in want.values())


def test_looped_texts(spark):
    rows = [(i, t) for i in [*range(60), None] for t in ("a b c d e f g h i j k l m", "one", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", queries.looped(df.doc_id, df.text).alias("t")).collect()
    assert all(brute.words(r["t"]) == brute.looped(r["doc_id"], brute.words(r["text"])) for r in got)


def test_periodic_edges(docs):
    got = periodic_runs.collapsed(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        ws = brute.words(r["doc"]["text"])
        assert [tuple(x) for x in r["runs"]] == ([(0, 30_000, 1)] if len(ws) > 100 else [])
        assert r["collapsed"] == (" ".join(ws) if len(ws) < 100 else " ".join(["pass", *ws[30_000:]]))


# Ranked lexical search


def test_search_on_the_smallest_tables(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    got = queries.op12_lexical_search(spark, FOLDER)
    assert dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == sorted(brute.ranked(docs, items))


def test_search_in_small_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(lexical_search, "MOST_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "SEEDS", 3)
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    docs = [(i, text(rnd.randrange(12))) for i in range(150)] + [(None, "ab cd"), (None, None), (7, "ab cd"), (7, "ab cd")]
    items = [(i, text(rnd.randrange(6))) for i in range(10)] + [(3, "ab"), (None, "cd"), (50, None)]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute.ranked(docs, items, 5), key=repr)


def test_tree_search_equals_all_pairs():
    rnd = random.Random(2)
    for _ in range(60):
        n_terms, n_docs, n_items, k = rnd.randrange(1, 40), rnd.randrange(1, 300), rnd.randrange(1, 60), rnd.randrange(1, 12)
        some = lambda most, times: {t: rnd.randrange(1, times) for t in rnd.sample(range(n_terms), rnd.randrange(0, min(n_terms, most) + 1))}
        docs, items = [some(6, 4) for _ in range(n_docs)], [some(8, 3) for _ in range(n_items)]
        search = lexical_search.Search(items, np.array([rnd.random() for _ in range(n_terms)]), k, np.zeros(n_items, np.int64))
        cut = rnd.randrange(n_docs + 1)
        for own in (range(cut), range(cut, n_docs)):
            if len(own):
                flat = [(j - own[0], t, v) for j in own for t, v in docs[j].items()]
                search.block(np.array(own), *(np.array([x[c] for x in flat], np.int64) for c in range(3)))
        want = []
        for i, q in enumerate(items):
            scores = sorted((-sum(m * d.get(t, 0) for t, m in q.items()), j) for j, d in enumerate(docs))
            want += [(i, j, -s) for s, j in scores[:k] if s]
        assert sorted(search.rows()) == sorted(want)


def test_trees_prune():
    """Documents far below the kth score are not scored one by one."""
    items = [{0: 1}]
    search = lexical_search.Search(items, np.array([0.0, 1.0]), 1, np.array([50]))
    seen = []
    settle = search.settle
    search.settle = lambda docs, ids, leaf, places: (seen.append(leaf), settle(docs, ids, leaf, places))
    doc = np.arange(4096)
    search.block(doc, doc, np.zeros(4096, np.int64), np.where(doc == 77, 60, 10))
    assert list(search.rows()) == [(0, 77, 60)] and len(seen) == 1


def test_search_edges(spark, docs):
    items = spark.createDataFrame([(1, "a B"), (1, "a B"), (None, "x"), (2, None), (3, "pass"), (4, "É é")], "item_id long, text string")
    got = sorted(map(tuple, lexical_search.search(docs, items).collect()), key=repr)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(brute.ranked(rows, [tuple(r) for r in items.collect()]), key=repr)
    assert lexical_search.search(docs, items.limit(0)).collect() == []


# Language ID


@pytest.fixture(scope="module")
def network():
    texts = [(" ".join(random.Random(i).choices(ws, k=60)).encode(), k) for i in range(40) for k, ws in (("xx", ["the", "and", "of"]), ("yy", ["der", "und", "von", "öl"]))]
    return language_id.train([t for t, _ in texts], [k for _, k in texts], steps=60)


def test_chances_equal_loops(network):
    texts = [b"the and of", b"", "öl und".encode(), ("der und von " * 40).encode(), bytes(range(1, 256))]
    whole = network.predict(texts)
    assert whole.tolist() == pytest.approx([pytest.approx(brute.convolved(network, t), abs=1e-4) for t in texts])


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = language_id.windows([bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (100, 128, 40, 3)])[0]
    label = np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.chances(net.pooled(x)[0].astype(np.float64))[np.arange(4), label]).mean()

    grad = net.gradients(x, label)
    for name, w in net.weights.items():
        for spot in [np.unravel_index(j, w.shape) for j in rng.integers(0, w.size, 12)]:
            if name == "kernel" and not language_id.taps()[spot[0] // language_id.EMBEDDED, 0, spot[1]]:
                assert grad[name][spot] == 0
                continue
            kept, step = w[spot], 1e-3
            w[spot] = kept + step
            up = loss()
            w[spot] = kept - step
            down = loss()
            w[spot] = kept
            assert grad[name][spot] == pytest.approx((up - down) / 2 / step, abs=2e-3)


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op11_language_id(spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100


def test_language_edges(docs, network):
    got = language_id.predicted(docs, network).collect()
    assert len(got) == docs.count()
    for r in got:
        empty = r["doc"]["doc_id"] in (2, 3, 4) or r["doc"]["text"] is None
        assert (r["lang_pred"] == "und") == empty and (r["score"] == 0) == empty
    assert all(r["lang_pred"] == "und" for r in language_id.predicted(docs, None).collect())


def test_language_sample(spark):
    rows = [(i % 7 if i % 3 else None, f"t{i}", [None, "a", "b"][i % 5 % 3]) for i in range(200)]
    few = language_id.sample(spark.createDataFrame(rows, "id long, text string, lang string"), 10).collect()
    assert sorted(r["lang"] for r in few) == ["a"] * 10 + ["b"] * 10
    assert language_id.fit(spark.createDataFrame([(1, "x", None)], "id long, text string, lang string")) is None
