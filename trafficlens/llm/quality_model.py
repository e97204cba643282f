"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PASSAGE = 512  # bytes
CLASSES = 16
FEATURES = CLASSES * CLASSES + 4
HIDDEN, GATE = 24, 12
# The model is fitted on at most so many labelled documents of each class, with all their passages.
SAMPLE_PER_CLASS = 1024
KEPT_PASSAGES = 64  # vectors of longer texts are made anew for every batch that has them
PIECE = 4096 * PASSAGE  # bytes that are encoded together; a word over the edge of two pieces counts in both
THRESHOLD = 0.7


def byte_classes() -> np.ndarray:
    """Class of each byte: vowels, consonants, capitals, digits, blanks, line ends, single marks, symbols, other marks, UTF-8 bytes, control."""
    table = np.full(256, 15, np.uint8)
    table[0x21:0x7F] = 12
    for k, members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".", b",", b"!", b"|", b"#*$%&<>", b"\"'")):
        table[list(members)] = k
    table[0x80:0xC0] = 13
    table[0xC0:] = 14
    return table


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, number of passages per text); an empty text is one zero vector.

    A vector has the roots of the shares of neighbouring byte classes, then mean word length, share of words seen
    before in the passage, share of words equal to the one before, and the passage's length.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(-(-lengths // PASSAGE), 1)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = int(counts.sum())
    out = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return out, counts
    text = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = (first[text] + inside * counts[text] // np.maximum(lengths[text], 1)).astype(np.int64)
    kind = byte_classes()[raw]
    same = passage[1:] == passage[:-1]
    cell = passage[1:] * (CLASSES * CLASSES) + kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    pairs = np.bincount(cell[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    size = np.bincount(passage, minlength=n)
    out[:, :-4] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    new_text = np.r_[True, text[1:] != text[:-1]]
    begins = ~blank & np.r_[True, blank[:-1] | new_text[1:]]
    start = np.flatnonzero(begins)
    if len(start):
        # Words as sums of bytes times powers of their place: equal words have equal sums, which is enough for shares.
        place = np.arange(len(raw)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        with np.errstate(over="ignore"):
            mark = np.add.reduceat(np.where(blank, np.uint64(0), raw * power[place & 63]), start)
        at, long = passage[start], np.add.reduceat((~blank).astype(np.int64), start)
        words = np.maximum(np.bincount(at, minlength=n), 1)
        order = np.lexsort((mark, at))
        again = (mark[order][1:] == mark[order][:-1]) & (at[order][1:] == at[order][:-1])
        before = (mark[1:] == mark[:-1]) & (at[1:] == at[:-1])
        out[:, -4] = np.minimum(np.bincount(at, weights=long, minlength=n) / words / 16, 4)
        out[:, -3] = np.bincount(at[order][1:][again], minlength=n) / words
        out[:, -2] = np.bincount(at[1:][before], minlength=n) / words
    out[:, -1] = size / PASSAGE
    return out, counts


def portions(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage vectors, text of each) of some texts at a time, long ones piece by piece, in order."""
    pieces, of, size = [], [], 0

    def encoded():
        x, counts = encode(pieces)
        return x, np.repeat(of, counts)

    for i, t in enumerate(texts):
        for k in range(0, max(len(t), 1), PIECE):
            pieces.append(t[k : k + PIECE])
            of.append(i)
            size += len(pieces[-1])
            if size >= PIECE:
                yield encoded()
                pieces, of, size = [], [], 0
    if pieces:
        yield encoded()


@dataclass
class Model:
    """Weights of the passage encoder, the gated attention and the scorer; without ``weights`` a constant score."""

    prior: float
    weights: dict[str, np.ndarray] | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts. Only what attention needs of a passage outlives its portion, a hidden vector and a number."""
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        parts = [(*hidden(self.weights, x)[::3], of) for x, of in portions(texts)]
        h, e, of = (np.concatenate(p) for p in zip(*parts))
        return pooled(self.weights, h, e, np.bincount(of, minlength=len(texts)))[2]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def hidden(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hidden vector, both factors of the gated attention, its logit) of each passage."""
    h = np.tanh(x @ w["encode"] + w["shift"])
    t, g = np.tanh(h @ w["attend"]), sigmoid(h @ w["gate"])
    return h, t, g, (t * g) @ w["rank"]


def pooled(w: dict, h: np.ndarray, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(attention of each passage within its text, weighted sum of the text's hidden vectors, score of that sum)."""
    first = np.r_[0, np.cumsum(counts)[:-1]]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
    a = e / np.repeat(np.add.reduceat(e, first), counts)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return a, z, sigmoid(z @ w["judge"] + w["bias"][0]).astype(np.float64)


def forward(w: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Passages to hidden vectors, gated attention over each text's passages, score of the weighted sum."""
    h, t, g, e = hidden(w, x)
    a, z, score = pooled(w, h, e, counts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}


def gradients(w: dict, x: np.ndarray, counts: np.ndarray, wrong: np.ndarray) -> dict:
    """Gradients of the weighted log loss; ``wrong`` is weight * (score - label)."""
    f = forward(w, x, counts)
    wrong = wrong(f["score"])
    h, t, g, a = f["h"], f["t"], f["g"], f["a"]
    to_z = np.repeat(wrong, counts)[:, None] * w["judge"]
    along = (to_z * h).sum(1)
    mean = np.repeat(np.add.reduceat(a * along, np.r_[0, np.cumsum(counts)[:-1]]), counts)
    to_e = a * (along - mean)
    to_t, to_g = to_e[:, None] * w["rank"] * g * (1 - t * t), to_e[:, None] * w["rank"] * t * g * (1 - g)
    to_h = (a[:, None] * to_z + to_t @ w["attend"].T + to_g @ w["gate"].T) * (1 - h * h)
    return {
        "encode": x.T @ to_h, "shift": to_h.sum(0), "attend": h.T @ to_t, "gate": h.T @ to_g, "rank": (t * g).T @ to_e,
        "judge": f["z"].T @ wrong, "bias": np.array([wrong.sum()]),
    }


def passages(text: bytes) -> np.ndarray:
    """All passage vectors of a text."""
    return np.concatenate([x for x, _ in portions([text])])


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, prior: float, steps: int = 900, batch: int = 64, rate: float = 0.004, seed: int = 1) -> Model:
    """Adam on all weights together, at least ``steps`` batches of whole texts (zstd-compressed), in a seeded order."""
    import zstandard

    kept: dict[int, np.ndarray] = {}

    def vectors(i: int) -> np.ndarray:
        if i in kept:
            return kept[i]
        x = passages(zstandard.decompress(texts[i]))
        if len(x) <= KEPT_PASSAGES:
            kept[i] = x
        return x

    rng = np.random.default_rng(seed)
    shapes = {"encode": (FEATURES, HIDDEN), "shift": (HIDDEN,), "attend": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "rank": (GATE,), "judge": (HIDDEN,), "bias": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("shift", "bias") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m, v, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    while step < steps:
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            parts = [vectors(i) for i in own]
            x, counts = np.concatenate(parts), np.array(list(map(len, parts)))
            grad = gradients(w, x, counts, lambda s: ((s - labels[own]) * weights[own] / weights[own].sum()).astype(np.float32))
            step += 1
            for name, g in grad.items():
                m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(prior, w)


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each class, in order of a hash of the id, of equal ids by a hash of the text: (id, text, label).

    Ids are chosen from the labels first, so only their documents are read on; an id may stand for many documents.
    """
    chosen = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    rows = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "text", "label")
    order = W.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_class).drop("n")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model from ``docs`` (id, text) and ``labels`` (id, label 0 or 1); ids are whole numbers.

    Class shares come from all labels, weights from a sample of at most ``per_class`` documents of each class, whose whole
    texts come to the driver compressed and are trained on there, all passages of each. Null ids and labels do not teach; an
    id with two labels counts once for each, and of the documents that share an id each one, as far as the sample
    goes. Null texts count as empty. With less than two classes every score is the smoothed share of label 1; without
    any label, and on an empty table, it is a half.
    """
    known = labels.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).select("id", F.col("label").cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return Model(prior)

    def compressed(batches):
        import zstandard

        for b in batches:
            texts = [zstandard.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(texts, pa.binary())], ["id", "label", "text"])

    rows = sample(docs, known, per_class).select("id", "label", "text").mapInArrow(compressed, "id long, label int, text binary").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["label"], bytes(r["text"])))
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(prior)
    share = np.array([prior if k else 1 - prior for k in y]) / np.array([(y == k).mean() for k in y])
    return train([bytes(r["text"]) for r in rows], y, share, prior)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (struct of the input row) and ``score`` in [0, 1].

    Whole texts, long ones in pieces of two megabytes, of which only the passages' hidden vectors stay: about a fifth of the
    text. Null texts count as empty, repeated rows repeat their score, an empty table gives an empty one; other columns are
    only carried inside ``doc``, whatever their names.
    """
    whole = docs.select(F.struct("*").alias("doc"))

    def judged(batches):
        for b in batches:
            texts = b.column("doc").field(text)
            scores, k = [], 0
            while k < len(texts):
                size, own = 0, []
                while k < len(texts) and size < PIECE:
                    own.append((texts[k].as_py() or "").encode())
                    size, k = size + len(own[-1]), k + 1
                scores.append(model.score(own))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], ["doc", "score"])

    return whole.mapInArrow(judged, whole.select("doc", F.lit(0.0).alias("score")).schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The input rows that score at least ``threshold``, columns unchanged."""
    return scored(docs, model, text).filter(F.col("score") >= threshold).select("doc.*")
