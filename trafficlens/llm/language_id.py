"""Language ID: a byte convolutional network with filters of several widths, max pooling and softmax over fixed windows."""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WINDOW = 128  # bytes
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4, 5), 12, 8
SPAN = max(WIDTHS)
# The network is trained on at most so many labelled texts of each language, with all their windows.
SAMPLE_PER_LANGUAGE = 256
PORTION = 1 << 20  # bytes of text that are judged together
ROWS = 256  # windows that pass the filters together
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of every window, zeros behind the end; windows of each text; text bytes of every window). An empty text has one window."""
    counts = np.array([max(-(-len(t) // WINDOW), 1) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    flat, at = out.reshape(-1), 0
    sizes = []
    for t, n in zip(texts, counts.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        sizes += [WINDOW] * (n - 1) + [len(t) - WINDOW * (n - 1)]
        at += n * WINDOW
    return out, counts, np.array(sizes, np.int64)


@dataclass
class Network:
    """``embed``: vector of each byte; ``kernel``: taps times vector by filter, zero beyond a filter's width; ``shift``; ``judge`` and ``bias``: softmax layer."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> "Network":
        n = FILTERS * len(WIDTHS)
        kernel = rng.normal(0, 0.3, (SPAN, EMBEDDED, n)) * taps()
        w = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDED)), "kernel": kernel.reshape(SPAN * EMBEDDED, n), "shift": np.zeros(n),
            "judge": rng.normal(0, 1 / np.sqrt(n), (n, len(languages))), "bias": np.zeros(len(languages)),
        }
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each window before the shift, and its place. Bytes behind a window count as zero."""
        w, n = self.weights, self.weights["shift"].shape[0]
        top, place = np.empty((len(x), n), np.float32), np.empty((len(x), n), np.int64)
        for k in range(0, len(x), ROWS):
            own = self.near(x[k : k + ROWS])
            seen = (own.reshape(-1, SPAN * EMBEDDED) @ w["kernel"]).reshape(len(own), WINDOW, n)
            place[k : k + ROWS] = seen.argmax(axis=1)
            top[k : k + ROWS] = np.take_along_axis(seen, place[k : k + ROWS, None], 1)[:, 0]
        return top, place

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Greatest response only."""
        w, n = self.weights, self.weights["shift"].shape[0]
        out = np.empty((len(x), n), np.float32)
        for k in range(0, len(x), ROWS):
            own = self.near(x[k : k + ROWS])
            out[k : k + ROWS] = (own.reshape(-1, SPAN * EMBEDDED) @ w["kernel"]).reshape(len(own), WINDOW, n).max(axis=1)
        return out

    def near(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the ``SPAN`` bytes from each place on, side by side."""
        padded = np.zeros((len(x), WINDOW + SPAN - 1), np.uint8)
        padded[:, :WINDOW] = x
        own = self.weights["embed"][padded]
        step = own.strides
        view = np.lib.stride_tricks.as_strided(own, (len(x), WINDOW, SPAN * EMBEDDED), (step[0], step[1], step[2]))
        return np.ascontiguousarray(view)

    def chances(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.weights["shift"], 0) @ self.weights["judge"] + self.weights["bias"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Chance of each language for each text: mean over its windows, weighted by their bytes."""
        x, counts, sizes = windows(texts)
        first = np.cumsum(counts) - counts
        weight = np.maximum(sizes, 1e-9)
        sums = np.add.reduceat(self.chances(self.responses(x)) * weight[:, None], first, axis=0)
        return sums / np.add.reduceat(weight, first)[:, None]

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the place of a filter's greatest response passes a gradient on."""
        w = self.weights
        top, place = self.pooled(x)
        hidden = np.maximum(top + w["shift"], 0)
        wrong = self.chances(top)
        wrong[np.arange(len(x)), label] -= 1
        wrong /= len(x)
        to_top = (wrong @ w["judge"].T) * (hidden > 0)
        padded = np.zeros((len(x), WINDOW + SPAN - 1), np.uint8)
        padded[:, :WINDOW] = x
        spots = padded[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(SPAN)]  # (window, filter, tap)
        seen = w["embed"][spots].reshape(len(x), -1, SPAN * EMBEDDED)
        kernel = np.einsum("nf,nfk->kf", to_top, seen, optimize=True).reshape(SPAN, EMBEDDED, -1) * taps()
        back = (to_top[:, :, None] * w["kernel"].T).reshape(len(x), -1, SPAN, EMBEDDED)
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, spots.reshape(-1), back.reshape(-1, EMBEDDED))
        return {"embed": embed, "kernel": kernel.reshape(w["kernel"].shape), "shift": to_top.sum(0), "judge": hidden.T @ wrong, "bias": wrong.sum(0)}


def taps() -> np.ndarray:
    """1 where a filter of its width has a tap: (tap, 1, filter)."""
    width = np.repeat(WIDTHS, FILTERS)
    return (np.arange(SPAN)[:, None] < width).astype(np.float32)[:, None]


def train(texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam over batches with as many windows of every language; a language's windows are drawn in a seeded order, round after round."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network.fresh(languages, rng)
    pools = [windows([t for t, k in zip(texts, labels) if k == name and t] or [b""])[0] for name in languages]
    orders, at = [rng.permutation(len(p)) for p in pools], [0] * len(pools)
    each = max(batch // len(languages), 2)
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = []
        for k, pool in enumerate(pools):
            if at[k] + each > len(pool):
                orders[k], at[k] = rng.permutation(len(pool)), 0
            rows.append(pool[orders[k][at[k] : at[k] + each]])
            at[k] += each
        grad = net.gradients(np.concatenate(rows), np.repeat(np.arange(len(pools)), list(map(len, rows))))
        slow = rate * min(1, 2 * (1 - step / (steps + 1)))
        for name, g in grad.items():
            m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g * g
            net.weights[name] = (net.weights[name] - slow * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): at most ``per_language`` rows of each language, by hash of the id; more rows of one id tie and are cut by text.

    The ids alone tell each language's last hash; texts are read of the rows up to it only.
    """
    keyed = docs.filter("lang is not null").withColumn("key", F.xxhash64("id"))
    upto = W.partitionBy("lang").orderBy("key")
    last = keyed.select("lang", "key").withColumn("n", F.row_number().over(upto)).filter(F.col("n") <= per_language)
    last = last.groupBy("lang").agg(F.max("key").alias("last"))
    few = keyed.join(F.broadcast(last), "lang").filter(F.col("key") <= F.col("last"))
    ranked = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("key", "text")))
    return ranked.filter(F.col("n") <= per_language).select("lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, steps: int = 500) -> Network | None:
    """Network from ``docs`` (id, text, lang). Null languages do not teach; null texts count as empty; without a label there is no network.

    At most ``per_language`` rows of each language come to the driver, with whole texts; the network is trained there.
    """
    rows = sorted((r["lang"], (r["text"] or "").encode()) for r in sample(docs, per_language).collect())
    return train([t for _, t in rows], [k for k, _ in rows], steps) if rows else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predicted(docs: DataFrame, network: Network | None, text: str | Column = "text") -> DataFrame:
    """``doc`` (struct of the input row), ``lang_pred`` and ``score``, the chance of that language.

    Whole texts are judged, window by window. Null texts and texts without a letter are ``und`` with score 0, and so is
    every text when there is no network; equal chances fall to the first language by name; repeated rows repeat their
    result; an empty table gives an empty one; other columns are only carried inside ``doc``. Memory grows with the
    longest text, by about three bytes for each of its own.
    """
    value = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(value, F.lit("")).alias("text"))

    def judged(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if network is not None and has_letter(t)]
            k = 0
            while k < len(known):
                own, size = [], 0
                while k < len(known) and size < PORTION:
                    own.append(known[k])
                    size, k = size + len(texts[known[k]]), k + 1
                chances = network.predict([texts[i].encode() for i in own])
                best = chances.argmax(axis=1)
                scores[own] = np.clip(chances[np.arange(len(own)), best], 0, 1)
                for i, j in zip(own, best.tolist()):
                    names[i] = network.languages[j]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc", "lang_pred", "score"])

    return rows.mapInArrow(judged, rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
