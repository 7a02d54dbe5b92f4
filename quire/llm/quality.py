"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (PASSAGE bytes each, all of the text). A passage's features are the shares of the pairs
of character classes in it, how often words of each of N_WORDS hash buckets stand in it, its length, and the share of its words that stood
in the document before. A dense layer encodes each passage; gated attention, tanh(Vh) * sigmoid(Uh), learnt from document labels alone, weighs them; the weighted sum
is scored by a logistic layer. Trained in numpy with Adam on a bounded sample of labelled rows (TRAINING_ROWS, and models.TRAINING_CHARACTERS of a
text; where ids repeat at most four times as many rows).

Defined results: a null or empty text is one passage without features; rows without a label, or whose document is
missing, aren't learnt from, and with no labels at all every score is 0.5; an empty table gives an empty result; a document with several labels is learnt
with each; repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blocks
from quire.llm.models import Adam, bounded_sample, by_crc, least_hashes, sigmoid, training_text

#: Bound on the labelled rows that are learnt from.
TRAINING_ROWS = 3000
PASSAGE, ENCODED, ATTENTION = 512, 16, 12
THRESHOLD = 0.3

#: A class for each byte: 0 space, 1 new line, 2 a-z, 3 A-Z, 4 digits, 5 full stops, 6 commas, 7 !?, 8 quotes,
#: 9 brackets, 10 #*$%&, 11 |<>, 12 -_/\\+=@, 13 control, 14 other ASCII, 15 beyond ASCII.
CLASS = np.full(256, 15, np.uint8)
CLASS[:128] = 14
CLASS[:32] = 13
for _k, _chars in enumerate([b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",;:", b"!?", b"\"'`", b"()[]{}", b"#*$%&", b"|<>", b"-_/\\+=@"]):
    CLASS[list(_chars)] = _k
N_CLASSES = 16
N_PAIRS, N_WORDS = N_CLASSES * N_CLASSES, 64
N_FEATURES = N_PAIRS + N_WORDS + 2
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c\x00")] = True
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, (n, N_FEATURES), and where each text's begin."""
    data = [(t or "").encode("utf-8", "replace") or b"\x00" for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    counts = -(-sizes // PASSAGE)
    starts = np.cumsum(counts) - counts
    flat = np.frombuffer(b"".join(data), np.uint8)
    doc = np.repeat(np.arange(len(data)), sizes)
    begin = np.cumsum(sizes) - sizes
    passage = starts[doc] + (np.arange(len(flat)) - begin[doc]) // PASSAGE
    n = int(counts.sum())
    kinds = CLASS[flat].astype(np.int64)
    pairs = kinds[:-1] * N_CLASSES + kinds[1:]
    inside = passage[:-1] == passage[1:]
    size = np.bincount(passage, minlength=n).astype(np.float32)
    features = np.zeros((n, N_FEATURES), np.float32)
    features[:, :N_PAIRS] = np.bincount((passage[:-1] * N_PAIRS + pairs)[inside], minlength=n * N_PAIRS).reshape(n, -1) / size[:, None]
    features[:, -2] = np.log1p(size) / 8
    # words as hashes, to see which stood in the same text before
    solid = ~BLANK[flat]
    edge = np.append(True, doc[1:] != doc[:-1])
    first = np.flatnonzero(solid & (edge | np.append(True, ~solid[:-1])))
    if len(first):
        word = np.cumsum(np.bincount(first, minlength=len(flat))) - 1
        at = np.flatnonzero(solid)
        owner = word[at]
        names = np.bincount(owner, minlength=len(first))
        place = np.minimum(at - first[owner], 63)
        hashes = np.add.reduceat((flat[at].astype(np.uint64) + 1) * POWERS[place], np.cumsum(names) - names)
        buckets = (hashes * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype(np.int64) % N_WORDS
        features[:, N_PAIRS:-2] = np.log1p(np.bincount(passage[first] * N_WORDS + buckets, minlength=n * N_WORDS).reshape(n, -1))
        hashes = hashes * np.uint64(0xC2B2AE3D27D4EB4F) ^ doc[first].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(first), bool)
        again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        total = np.bincount(passage[first], minlength=n)
        features[:, -1] = np.bincount(passage[first], weights=again, minlength=n) / np.maximum(total, 1)
    return features, starts


class AttentionModel:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.weights = {"encoder": draw(N_FEATURES, ENCODED), "encoder_bias": np.zeros(ENCODED, np.float32), "v": draw(ENCODED, ATTENTION), "u": draw(ENCODED, ATTENTION), "w": draw(ATTENTION, 1), "output": np.zeros((ENCODED, 1), np.float32), "bias": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.weights
        counts = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["encoder"] + p["encoder_bias"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = ((t * g) @ p["w"])[:, 0]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return counts, h, t, g, a, z, sigmoid((z @ p["output"])[:, 0] + p["bias"][0])

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = 250, decay: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.01)
        x = (x - self.mean) * self.scale
        p = self.weights
        adam = Adam(p, 0.01)
        for _ in range(rounds):
            counts, h, t, g, a, z, s = self._forward(x, starts)
            d = ((s - labels) / len(labels)).astype(np.float32)
            dz = d[:, None] * p["output"][:, 0]
            of = np.repeat(dz, counts, axis=0)
            da = (of * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
            dtg = de[:, None] * p["w"][:, 0]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[:, None] * of + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            gradients = {"encoder": x.T @ dh, "encoder_bias": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ de[:, None], "output": z.T @ d[:, None], "bias": d.sum(keepdims=True)}
            adam.update({k: v + decay * p[k] * (k in ("encoder", "output")) for k, v in gradients.items()})

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, starts = passages(texts)
        return self._forward((x - self.mean) * self.scale, starts)[-1]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = TRAINING_ROWS) -> AttentionModel:
    """A model from about `rows` labels whose fold isn't 0."""
    wanted = labels.where((by_crc("doc_id", 5) != 0) & F.col(label_column).isNotNull()).select(F.col("doc_id"), F.col(label_column).cast("int").alias("label"))
    chosen = F.broadcast(bounded_sample(wanted, rows))  # bounded by twice `rows`
    got = least_hashes(docs.select(F.col(id_column).alias("doc_id"), training_text(id_column, text_column).alias("text")).join(chosen, "doc_id"), 4 * rows).collect()
    sample = sorted((r["doc_id"], r["label"], r["text"] or "") for r in got)
    model = AttentionModel()
    if sample:
        x, starts = _passages_in_parts([t for _, _, t in sample])
        model.fit(x, starts, np.array([y for _, y, _ in sample], np.float32))
    return model


def _passages_in_parts(texts: list[str], most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """As passages(), a bounded number of characters at a time, since what a character takes on the way is far more than what its passage keeps."""
    features, starts, n, at = [], [], 0, 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        x, s = passages(texts[at:end])
        features.append(x)
        starts.append(s + n)
        n, at = n + len(x), end
    return np.concatenate(features), np.concatenate(starts)


def score(docs: DataFrame, model: AttentionModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs' rows as (doc_id, held_out, score, predicted)."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=1_000_000):
            got = model.score(batch.column("text").to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_column).alias("doc_id"), (by_crc(id_column, 5) == 0).alias("held_out"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: AttentionModel, text_column: str = "text") -> DataFrame:
    """The rows of docs that are predicted to be of label 1, with all their columns; of an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_column, 1_000_000):
            good = model.score(batch.column(text_column).to_pylist()).astype(np.float64) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
