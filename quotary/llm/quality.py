"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. A first layer of filters over windows of bytes is a table
look-up, as its input is one of 256 values at each place; its responses are averaged over short stretches, a second
layer combines stretches, and each second-layer filter is max-pooled over the whole document and averaged too. One
logistic unit on the pooled values gives the probability. Training is by Adam on the whole texts of a bounded, stated
number of labelled rows; scoring reads every byte.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import table
from quotary.llm.shingles import binary, slices

#: Labelled rows that the network is fitted on at most, half of each label where there are enough.
MOST_LABELLED = 1200
#: Steps, texts of a step, the greatest rate, and networks.
STEPS, BATCH, RATE, SEEDS = 260, 24, 0.01, 2
#: Filters and window of the first layer, bytes of a stretch, filters of the second layer.
FILTERS, WINDOW, STRETCH, SECOND = 16, 4, 16, 12
#: Stretches of a chunk, and those over which a second-layer window reaches: chunks overlap by one less.
CHUNK, REACH = 4096, 3
THRESHOLD = 0.3


class Network:
    """Weights: t[k] a table of 256 x FILTERS for each byte of the window, u over REACH stretches, v over pooled values."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.w = {
            "t": rng.normal(0, 0.5, (WINDOW, 256, FILTERS)).astype(np.float32),
            "a": np.zeros(FILTERS, np.float32),
            "u": rng.normal(0, 0.2, (REACH, FILTERS, SECOND)).astype(np.float32),
            "b": np.zeros(SECOND, np.float32),
            "v": rng.normal(0, 0.2, 2 * SECOND).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responses at each byte of each stretch, their means). rows: stretches with the WINDOW - 1 bytes that follow."""
        z = self.w["t"][0][rows[:, :STRETCH]]
        for k in range(1, WINDOW):
            z += self.w["t"][k][rows[:, k : k + STRETCH]]
        z += self.w["a"]
        np.maximum(z, 0, out=z)
        return z, z.mean(axis=1)

    def second(self, means: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Responses of the second layer at the places `at`, each over REACH stretches from there on."""
        return np.maximum(sum(means[at + k] @ self.w["u"][k] for k in range(REACH)) + self.w["b"], 0)

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, dict]:
        """(loss, gradients) of whole padded texts of any lengths."""
        rows, n = stretches(texts)
        z1, means = self.first(rows)
        at, n = places(n)
        z2 = self.second(means, at)
        begin, cols = np.cumsum(n) - n, np.arange(SECOND)[None]
        top = np.stack([z2[b : b + k].argmax(axis=0) + b for b, k in zip(begin, n, strict=True)])
        pooled = np.concatenate([z2[top, cols], np.add.reduceat(z2, begin) / n[:, None]], axis=1)
        p = 1 / (1 + np.exp(-(pooled @ self.w["v"] + self.w["c"][0])))
        err = (p - y) / len(y)
        g = {"v": pooled.T @ err, "c": np.array([err.sum()])}
        back = err[:, None] * self.w["v"][None]
        d2 = np.repeat(back[:, SECOND:] / n[:, None], n, axis=0).astype(np.float32)
        np.add.at(d2, (top, cols), back[:, :SECOND])
        d2 *= z2 > 0
        g["b"] = d2.sum(axis=0)
        g["u"] = np.stack([means[at + k].T @ d2 for k in range(REACH)])
        d1 = np.zeros_like(means)
        for k in range(REACH):
            d1[at + k] += d2 @ self.w["u"][k].T
        dz = ((d1 / STRETCH)[:, None] * (z1 > 0)).reshape(-1, FILTERS)
        g["a"] = dz.sum(axis=0)
        t = np.zeros((WINDOW, 256, FILTERS), np.float32)
        for k in range(WINDOW):
            seen = rows[:, k : k + STRETCH].ravel()
            order = np.argsort(seen, kind="stable")
            seen = seen[order]
            edge = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            t[k][seen[edge]] = np.add.reduceat(dz[order], edge, axis=0)
        g["t"] = t
        loss = -np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))
        return float(loss), g


class Scorer:
    """Networks side by side: one look-up, in tables of byte pairs, serves the first layers of all of them."""

    def __init__(self, nets: list[Network]):
        self.nets = nets
        t = np.concatenate([net.w["t"] for net in nets], axis=2)
        self.pairs = [(t[k][:, None] + t[k + 1][None, :]).reshape(1 << 16, -1) for k in range(0, WINDOW, 2)]
        self.pairs[0] += np.concatenate([net.w["a"] for net in nets])

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Mean probability of label 1 over each whole text. The empty text is read as blank stretches, as all short texts
        are filled up with blanks. Texts are scored many at a time, long ones in chunks."""
        out, at = [0.0] * len(texts), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or b"") <= CHUNK * STRETCH):
                size += len(texts[to] or b"") + (REACH + 1) * STRETCH
                to += 1
            out[at:to] = self._some([_padded(t or b"") for t in texts[at:to]])
            at = to
        return out

    def _some(self, texts: list[np.ndarray]) -> list[float]:
        if len(texts) > 1:
            high, mean = self._pooled(texts)
        else:  # chunks overlap by REACH - 1 stretches and WINDOW - 1 bytes
            n = (len(texts[0]) - WINDOW + 1) // STRETCH
            high, mean = None, 0
            for lo in range(0, n - REACH + 1, CHUNK):
                hi = min(n, lo + CHUNK + REACH - 1)
                one, part = self._pooled([texts[0][lo * STRETCH : hi * STRETCH + WINDOW - 1]])
                high = one if high is None else np.maximum(high, one)
                mean = mean + part * ((hi - lo - REACH + 1) / (n - REACH + 1))
        both = np.concatenate([high, mean], axis=2)
        x = np.stack([both[i] @ net.w["v"] + net.w["c"][0] for i, net in enumerate(self.nets)])
        return (1 / (1 + np.exp(-np.clip(x.astype(np.float64), -60, 60)))).mean(axis=0).tolist()

    def _pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(maxima, means), networks x texts x SECOND."""
        rest = np.full(STRETCH, 0x20, np.uint8)  # to whole stretches: each text has one more, which is left out
        data = np.concatenate([part for x in texts for part in (x, rest[: STRETCH - WINDOW + 1])] + [rest[: WINDOW - 1]]).astype(np.uint16)
        pair = (data[:-1] << np.uint16(8)) | data[1:]
        z = self.pairs[0][pair[: len(pair) - 2]]
        z += self.pairs[1][pair[2:]]
        np.maximum(z, 0, out=z)
        means = z.reshape(-1, STRETCH, z.shape[1]).mean(axis=1)
        at, n = places(np.array([len(x) // STRETCH for x in texts]), 1)
        begin = np.cumsum(n) - n
        z2 = [net.second(means[:, i * FILTERS : (i + 1) * FILTERS], at) for i, net in enumerate(self.nets)]
        return np.stack([np.maximum.reduceat(x, begin) for x in z2]), np.stack([np.add.reduceat(x, begin) / n[:, None] for x in z2])


def stretches(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of padded texts with the bytes that their last windows reach over, number of each text's)."""
    rows = [np.lib.stride_tricks.sliding_window_view(x, STRETCH + WINDOW - 1)[::STRETCH] for x in texts]
    return np.concatenate(rows), np.array([len(r) for r in rows])


def places(n: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(where second-layer windows begin so that none reaches over two texts, number of each text's), of texts of n stretches
    with `skip` others after each."""
    k, m = n - REACH + 1, n + skip
    return np.arange(k.sum()) + np.repeat((np.cumsum(m) - m) - (np.cumsum(k) - k), k), k


def _padded(text: bytes) -> np.ndarray:
    """The text's bytes, filled up with blanks to whole stretches, REACH of them at least, and the window's rest."""
    stretches = max(REACH, -(-len(text) // STRETCH))
    out = np.full(stretches * STRETCH + WINDOW - 1, 0x20, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Network:
    """A network fitted to labelled texts: whole texts, in batches with as many of either label."""
    net, rng = Network(seed), np.random.default_rng(seed + 1)
    sides = [np.flatnonzero(labels == v) for v in (0, 1)]
    if not all(len(s) for s in sides):  # one label only, or none: a constant
        net.w["v"][:] = 0
        net.w["c"][:] = 4.0 if len(sides[1]) else (-4.0 if len(sides[0]) else 0.0)
        return net
    m, s = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    padded = [_padded(t) for t in texts]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
        _, grads = net.step([padded[j] for j in pick], labels[pick].astype(np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, w in net.w.items():
            grad = grads[k].astype(np.float32) + 1e-5 * w
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad * grad
            w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return net


def learnable(key) -> object:
    """Whether a row's label may be learned from: crc32 of the key as text, modulo 5, isn't 0."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> list[Network]:
    """Networks fitted on at most `most` labelled rows (a documented bound), chosen by a hash of the key, half of each
    label where there are enough. Rows with a null text, key or label and keys outside `learnable` aren't read."""
    marked = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & learnable(F.col("_k"))).dropDuplicates(["_k"])
    order = F.md5(F.col("_k").cast("string"))
    few = marked.where("_y = 0").orderBy(order).limit(most // 2).unionByName(marked.where("_y = 1").orderBy(order).limit(most // 2))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null").join(F.broadcast(few), "_k").orderBy(order, F.md5("_t")).limit(2 * most)
    got = rows.select("_y", F.encode("_t", "UTF-8").alias("_t")).collect()  # bounded by 2 * most rows
    texts, y = [bytes(r["_t"]) for r in got], np.array([r["_y"] for r in got], np.int64)
    return [train(texts, y, seed) for seed in range(SEEDS)]


def with_score(docs: DataFrame, nets: list[Network], *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1: the mean of the networks'. Nulls are scored as empty texts.

    Only the text is an input. A column of docs named `out` is replaced, all others are kept; equal texts have equal
    scores but for the rounding of single-precision sums; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(nets)  # fixed size: some 70 kB a network

    def score(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, text=text):
                got = scorer.scores(binary(batch.column(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the rows that may be learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nets = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, nets).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
