"""Language ID by a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length; filters of several widths over byte embeddings, max
pooling over the window and a softmax layer give each window's languages, and a text has the mean over all its
windows, by their number of bytes. Trained on windows of a bounded sample of labelled rows (TRAINING_ROWS,
WINDOWS_EACH of a language, and models.TRAINING_CHARACTERS of a text). For use, the first two and last two taps of all filters are tabled for each pair of
bytes, so that a place takes two table rows and no product.

Defined results: a null text, or one without a letter, is `und` with score 0; rows with a null language
or text aren't learnt from; with no such rows at all every text is `und`; repeated rows give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blocks
from quire.llm.models import Adam, bounded_sample, by_crc, softmax, training_text

#: Bounds on what is learnt from: labelled rows of all, and windows of each language.
TRAINING_ROWS, WINDOWS_EACH = 3000, 2500
WINDOW, WIDTHS, FILTERS, EMBEDDING = 96, (2, 3, 4), 16, 8
TAPS = max(WIDTHS)
#: Of the Unicode categories L; other numerals than digits, as ½ or Ⅷ, aren't letters.
LETTER = regex.compile(r"\p{L}")


class ByteNetwork:
    """languages: labels in order. weights: embedding (256, e), filters (widths, taps, e, filters) zero beyond a width, bias, output, output_bias."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        k = len(WIDTHS) * FILTERS
        self.languages = languages
        self.mask = np.zeros((TAPS, 1, k), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.weights = {
            "embedding": r.normal(0, 0.5, (256, EMBEDDING)),
            "filters": r.normal(0, 0.3, (TAPS, EMBEDDING, k)) * self.mask,
            "bias": np.zeros(k),
            "output": r.normal(0, 0.3, (k, max(1, len(languages)))),
            "output_bias": np.zeros(max(1, len(languages))),
        }
        self.weights = {n: w.astype(np.float32) for n, w in self.weights.items()}

    def fit(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 400, batch: int = 256, seed: int = 7) -> None:
        """windows: (n, WINDOW + TAPS - 1) bytes."""
        r, p = np.random.default_rng(seed), self.weights
        adam = Adam(p, 0.005)
        for step in range(rounds):
            adam.rate = 0.005 * (1 - step / rounds) + 0.0005
            take = r.integers(0, len(windows), batch)
            x, y = windows[take], labels[take]
            e = p["embedding"][x]
            conv = sum(e[:, t : t + WINDOW] @ p["filters"][t] for t in range(TAPS))
            best = conv.argmax(axis=1)
            top = np.take_along_axis(conv, best[:, None], 1)[:, 0]
            hidden = np.maximum(top + p["bias"], 0)
            d = softmax(hidden @ p["output"] + p["output_bias"])
            d[np.arange(batch), y] -= 1
            d /= batch
            dh = (d @ p["output"].T) * (hidden > 0)
            df, de = np.zeros_like(p["filters"]), np.zeros_like(p["embedding"])
            row = np.arange(batch)[:, None]
            for t in range(TAPS):
                at = e[row, best + t]  # (batch, filters, embedding)
                df[t] = np.einsum("bfe,bf->ef", at, dh)
                np.add.at(de, x[row, best + t].ravel(), (dh[:, :, None] * p["filters"][t].T[None]).reshape(-1, EMBEDDING))
            adam.update({"embedding": de, "filters": df * self.mask, "bias": dh.sum(0), "output": hidden.T @ d, "output_bias": d.sum(0)})

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For a pair of bytes (first * 256 + second), what taps 0 and 1, and taps 2 and 3 give."""
        taps = [self.weights["embedding"] @ f for f in self.weights["filters"]]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        return pair(taps[0], taps[1]), pair(taps[2], taps[3])


def pad(text: str) -> bytes:
    """The bytes of a text up to whole windows, with what the last taps look at beyond."""
    data = text.encode("utf-8", "replace")
    return data + bytes(-len(data) % WINDOW)


def predict(texts: list[str | None], network: ByteNetwork, tables: tuple[np.ndarray, np.ndarray], at_once: int = 512) -> list[tuple[str, float]]:
    first, last = tables
    p, out = network.weights, [("und", 0.0)] * len(texts)
    if not network.languages:
        return out
    wanted = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not wanted:
        return out
    data = [pad(texts[i]) for i in wanted]
    counts = np.array([len(d) // WINDOW for d in data])
    ends = np.cumsum(counts) - 1
    flat = np.frombuffer(b"".join(data), np.uint8).reshape(-1, WINDOW)
    used = np.count_nonzero(flat, axis=1).astype(np.float32)
    after = np.zeros((len(flat), TAPS - 1), np.uint8)  # the first bytes of the same text's next window
    after[:-1] = flat[1:, : TAPS - 1]
    after[ends] = 0
    probabilities = np.empty((len(flat), len(network.languages)), np.float32)
    for s in range(0, len(flat), at_once):
        x = np.concatenate([flat[s : s + at_once], after[s : s + at_once]], axis=1).astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        conv = first[pairs[:, :WINDOW]]
        conv += last[pairs[:, 2:]]
        probabilities[s : s + at_once] = softmax(np.maximum(conv.max(axis=1) + p["bias"], 0) @ p["output"] + p["output_bias"])
    starts = np.append(0, ends[:-1] + 1)
    mean = np.add.reduceat(probabilities * used[:, None], starts) / np.maximum(np.add.reduceat(used, starts), 1)[:, None]
    for i, m in zip(wanted, mean):
        out[i] = (network.languages[int(m.argmax())], float(min(1.0, m.max())))
    return out


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", rows: int = TRAINING_ROWS, each: int = WINDOWS_EACH) -> ByteNetwork:
    """A network from about `rows` rows whose fold isn't 2."""
    labelled = docs.where((by_crc(id_column, 4) != 2) & F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("doc_id"), training_text(id_column, text_column).alias("text"), F.col(language_column).cast("string").alias("lang"))
    sample = sorted((r["lang"], r["doc_id"] is None, r["doc_id"], r["text"]) for r in bounded_sample(labelled, rows).collect() if LETTER.search(r["text"]))
    languages = sorted({s[0] for s in sample})
    network, windows, labels, r = ByteNetwork(languages), [], [], np.random.default_rng(11)
    for k, language in enumerate(languages):
        data = [pad(s[3]) + bytes(TAPS - 1) for s in sample if s[0] == language]
        weight = np.array([len(d) // WINDOW for d in data], float)
        # as many windows of short texts as of long ones, half and half, as both are to be told apart
        for i in r.choice(len(data), each, p=0.5 * weight / weight.sum() + 0.5 / len(data)):
            s = WINDOW * int(r.integers(len(data[i]) // WINDOW))
            windows.append(np.frombuffer(data[i], np.uint8, WINDOW + TAPS - 1, s))
            labels.append(k)
    if windows:
        network.fit(np.array(windows), np.array(labels))
    return network


def identify(docs: DataFrame, network: ByteNetwork, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in blocks(batches, most=1_000_000):
            found = predict(batch.column("text").to_pylist(), network, tables)
            languages, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_column).alias("doc_id"), (by_crc(id_column, 4) == 2).alias("held_out"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
