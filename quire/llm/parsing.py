"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, phrases into phrases of phrases, and so on until one is left. At each level runs
of one symbol become a symbol; deterministic coin tossing then gives each symbol a label from the lowest bit in
which it differs from the one before, four times over, so that few labels remain and neighbours differ;
phrases begin at labels larger than both neighbours', and are named by a hash of their symbols. Where a phrase begins depends on a
few symbols around, so equal substrings get equal phrases inside wherever they stand. The fingerprint is the set of all
names (32 bits) from level LEVEL (phrases of some 27 characters) to the top, and the likeness of two is the exact share of names they
have in common (Jaccard); what is equal on a larger scale counts on every level. It takes about as many bytes as a third of the text.

Texts of a block are parsed together in flat arrays.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, alike to an empty one (1) and unlike all
others (0); ids are integers, and null ones stand before all others; rows of equal id go by the hash of their texts; with
one row the next document is that row itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import blocks

LEVEL = 3
ONE, BASE = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(256, BASE, np.uint64))
LEAST = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the result depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _named(symbols: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """A name for each phrase, from its symbols and their order."""
    lengths = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(mix(symbols) * POWERS[np.minimum(place, 255)], starts) + lengths.astype(np.uint64) + np.uint64(level << 32))


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 by coin tossing; neighbours within a text differ, as their symbols do. first: where texts begin."""
    labels = symbols
    for _ in range(4):
        apart = labels.copy()
        apart[1:] ^= labels[:-1]
        apart[first] = ONE
        lowest = apart & (~apart + ONE)
        k = np.bitwise_count(lowest - ONE).astype(np.uint64)
        labels = k * np.uint64(2) + ((labels & lowest) != 0)
    return labels.astype(np.int8)


def parse(symbols: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of the next level, and the text that each belongs to."""
    if not len(symbols):
        return symbols, doc
    new = np.append(True, (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    symbols, doc = np.where(run > ONE, mix(symbols[at] + run * BASE), symbols[at]), doc[at]
    first = np.append(True, doc[1:] != doc[:-1])
    labels = _labels(symbols, first)
    before, after = np.empty_like(labels), np.empty_like(labels)
    before[1:], after[:-1] = labels[:-1], labels[1:]
    before[0] = after[-1] = 99
    ends = np.append(first[1:], True)
    starts = np.flatnonzero(first | ((labels > before) & (labels > after) & ~ends))
    return _named(symbols, starts, level), doc[starts]


def sketches(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its names as 8 hexadecimal digits each, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    doc, level, all_names, all_docs = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), 0, [], []
    while len(symbols):
        level += 1
        symbols, doc = parse(symbols, doc, level)
        if level >= LEVEL:
            all_names.append(mix(symbols ^ BASE) >> np.uint64(32))
            all_docs.append(doc)
            going = np.bincount(doc, minlength=len(texts))[doc] > 1  # a text that is one phrase is done
            symbols, doc = symbols[going], doc[going]
    pairs = np.concatenate([np.empty(0, np.uint64), *(n | d.astype(np.uint64) << np.uint64(32) for n, d in zip(all_names, all_docs))])
    pairs = np.unique(pairs)
    ends = 8 * np.searchsorted(pairs, np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    digits = pairs.astype(">u4").tobytes().hex()
    return [digits[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]


def likeness(a: str, b: str) -> float:
    """The share of phrase names that two fingerprints' texts have in common."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (a, b))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint)."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sketches([t or "" for t in batch.column("text").to_pylist()]), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(bucket, ghost, id, text), each partition in that order: runs of ascending ids, each closed by a ghost, the row that follows the run.

    Runs hold about equal numbers of rows (approximate quantiles of the ids, a few for each shuffle partition); an id that is
    several of the quantiles has as many runs, by ranges of its texts' hashes. The first row of a run is sent to the run
    before as well, the first of all to the last. So the next row of any is at hand without one task seeing all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(LEAST)).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    runs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.sort(np.array(rows.agg(F.percentile_approx("id", [i / runs for i in range(1, runs)], 100 * runs)).first()[0] or [], np.int64))

    def buckets(i, h) -> np.ndarray:
        first, after = np.searchsorted(bounds, i, side="left"), np.searchsorted(bounds, i, side="right")
        part = (h.astype(np.float64) / 2.0**64 + 0.5) * (after - first)  # from 0 to the number of runs that the id has
        return np.where(after > first, np.minimum(first + 1 + part.astype(np.int64), after), first).astype(np.int32)

    @F.pandas_udf(T.IntegerType())
    def run_of(i, h):
        import pandas as pd

        return pd.Series(buckets(i.to_numpy(), h.to_numpy()))

    # as many rows as there are runs
    firsts = [(r["bucket"], r["first"]["id"], r["first"]["hash"]) for r in rows.select("id", "hash").withColumn("bucket", run_of("id", "hash")).groupBy("bucket").agg(F.min(F.struct("id", "hash")).alias("first")).orderBy("bucket").collect()]
    before = {(i, h): firsts[k - 1][0] for k, (_, i, h) in enumerate(firsts)}

    @F.pandas_udf("array<struct<bucket:int,ghost:boolean>>")
    def places(i, h):
        import pandas as pd

        own = buckets(i.to_numpy(), h.to_numpy()).tolist()
        return pd.Series([[{"bucket": b, "ghost": False}, {"bucket": before[x], "ghost": True}] if x in before else [{"bucket": b, "ghost": False}] for x, b in zip(zip(i.tolist(), h.tolist()), own)], dtype=object)

    rows = rows.withColumn("p", F.explode(places("id", "hash"))).select("p.bucket", "p.ghost", "id", "text", "hash")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ghost", "id", "hash").drop("hash")


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text beside itself with its last quarter replaced by the next document's beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, with its fingerprint, until the next one is here
        for batch in blocks(batches, most=1_000_000):
            texts = batch.column("text").to_pylist()
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("ghost").to_pylist(), batch.column("id").to_pylist(), texts, sketches(texts), strict=True))
            rows = rows if held is None else [held, *rows]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            edits = [_edited(a[3], b[3]) for a, b in pairs]
            prints = sketches(edits)
            columns = [
                [None if a[2] == LEAST else a[2] for a, _ in pairs],
                [len(a[3]) for a, _ in pairs],
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
                [a[4] for a, _ in pairs],
                prints,
                [likeness(a[4], p) for (a, _), p in zip(pairs, prints)],
                [likeness(a[4], b[4]) for a, b in pairs],
            ]
            held = rows[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
