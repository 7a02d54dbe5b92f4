"""Lexical retrieval packing.

Documents become sequences of WINDOW tokens. They are sharded by content: each has a key of KEYS min-hashes over its distinct token ids,
rarer ids of the vocabulary being likelier to be the least, and runs of up to SHARD_DOCUMENTS rows or SHARD_TOKENS tokens in the order of the
keys are a shard, so that documents with words in common, copies above all, stand together wherever they came from. Each shard has
a BM25 inverted index over token ids, with document frequencies and the mean length of the whole corpus. A seed document opens a
window; the index scores all of the shard by all of the seed's terms and returns its unused neighbours, best first, and those that fit
whole go in; the best that doesn't fit is cut to fill the window, and its rest is the seed of the next. Only where no neighbour
is left the next unused document in order comes in. A window that is open at the end of a shard goes on in the next, and what
is open at the end of a partition is cut into sequences of powers of two, which need no padding.

Texts are tokenised once, into a table, and equal parts of a block's texts once for all, cut where the pattern always ends a match; ids and keys are what is shuffled, by ranges of (key, place), so that documents of one key, however
many, are split. Sequence ids hold the partition and a count within it; a partition that is computed again gives the same.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed each; ids may be
null or tie; an empty table gives no sequence; a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordTable, blocks, checkpointed, cut, joined, offsets

WINDOW = 1024
SHARD_DOCUMENTS, SHARD_TOKENS = 512, 1_000_000
END = 0
VOCABULARY, KEYS = 1 << 16, 3
#: Of token ids that a task should read at most.
TASK_BYTES = 64 << 20
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"
#: Parts of texts whose ids a worker keeps.
KEPT_PARTS = 200_000
#: By byte of UTF-8, for bytes.translate: 1 letters, 2 the first of two bytes of U+00C0 to U+023F, 4 white space, 8 digits, 16 an apostrophe, 32 all else that is printed, of ASCII; else 0.
KINDS = bytes(
    (1 if chr(b).isalpha() else 4 if 9 <= b <= 13 or b == 32 else 8 if chr(b).isdigit() else 16 if b == 39 else 32 if 32 < b < 127 else 0) if b < 0x80 else 2 * (0xC3 <= b < 0xC9) for b in range(256)
)
#: The pattern that KINDS and part_begins() are for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def part_begins(data: np.ndarray) -> np.ndarray:
    """Where bytes of texts can be cut so that parts have the ids they have in the text: PATTERN always ends a match there, as it has nothing
    but a space before other characters, and none of its matches looks on, as no white space stands before a cut. A part begins with white space
    after another character, and where a letter meets another printed character, unless that is an apostrophe before it."""
    kind = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
    letter = kind == 1
    last = letter.copy()  # whether a letter's last byte is there
    two = (kind[:-1] == 2) & (data[1:] & 0xDF != 0x97)  # but the signs of multiplication and division
    letter[:-1] |= two
    last[1:] |= two
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] == 4) & (last[:-1] | (kind[:-1] >= 8)) | (kind[1:] >= 16) & last[:-1] | letter[1:] & (kind[:-1] == 32)
    return begins


class Tokenizer:
    """Ids as the tokenizers file gives them. The same vocabulary as ranks encodes texts without its special token several times faster; others are left to the file itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer as FromFile

        self.whole = FromFile.from_file(json_path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cuts = part_begins if pattern == PATTERN else lambda data: np.zeros(len(data), bool)
        self.table = WordTable(pa.large_binary())  # of parts of texts: ids as 16-bit integers

    def encode(self, text: str) -> np.ndarray:
        ids = self.whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else self.fast.encode_ordinary(text)
        return np.array([*ids, END], np.uint16)

    def encode_block(self, texts: pa.Array) -> list[np.ndarray]:
        """As encode() each; a null is empty. Equal parts of texts are encoded once, and kept in a table."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = pc.match_substring(texts, SPECIAL)
        parts, ends = cut(pc.if_else(special, "", texts), self.cuts)
        rows = self.table.rows(parts.dictionary, self._values, KEPT_PARTS)[parts.indices.to_numpy()]
        ids = joined(self.table.columns[0].take(pa.array(rows)), ends)
        at = (offsets(ids) // 2).tolist()
        flat = np.frombuffer(ids.buffers()[2], np.uint16)
        out = [np.append(flat[a:b], np.uint16(END)) for a, b in zip(at, at[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out

    def _values(self, parts: list[str]) -> tuple[pa.Array]:
        ids = list(map(self.fast.encode_ordinary, parts))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, ends[-1] if len(ends) else 0)
        return (pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.append(0, 2 * ends)), pa.py_buffer(flat)]),)


@lru_cache(2)
def load(json_path: str, ranks_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(json_path, ranks_path, pattern)


@lru_cache(1)
def _draws() -> np.ndarray:
    """(KEYS, VOCABULARY): an exponential draw for each id, at a rate that grows with the id, as a vocabulary's ids go from common to rare."""
    uniform = np.random.default_rng(2).random((KEYS, VOCABULARY))
    return -np.log(1 - uniform) / np.log2(2 + np.arange(VOCABULARY))


def shard_key(distinct: np.ndarray) -> int:
    """The ids of the least draw, the first of KEYS in the highest bits."""
    key = 0
    for draws in _draws():
        key = key << 16 | int(distinct[draws[distinct].argmin()])
    return key


class Corpus:
    """What an index needs to know of the whole corpus: documents, documents with each id, tokens in all."""

    def __init__(self, documents: int, frequencies: np.ndarray, tokens: int) -> None:
        self.tokens, self.mean = tokens, max(1, tokens) / max(1, documents)
        self.idf = np.log1p((documents - frequencies + 0.5) / (frequencies + 0.5))


class Shard:
    """A BM25 inverted index over the token ids of some documents."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus) -> None:
        n = len(ids)
        sizes = np.fromiter(map(len, ids), np.int64, n)
        tokens, doc = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(n), sizes)
        keys, tf = np.unique(tokens << 16 | doc, return_counts=True)
        term, self.doc = keys >> 16, keys & 0xFFFF
        self.weight = corpus.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (sizes / corpus.mean)[self.doc]))
        self.begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.df = np.diff(np.append(self.begin, len(term)))
        of = np.repeat(np.arange(len(self.begin)), self.df)
        # each document's terms that another document has too
        shared = np.flatnonzero(self.df[of] > 1)
        order = shared[np.argsort(self.doc[shared], kind="stable")]
        self.terms, self.first = of[order], np.searchsorted(self.doc[order], np.arange(n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents that share a term with the seed, best first; ties in order."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        n = self.df[terms]
        at = np.arange(n.sum()) + np.repeat(self.begin[terms] - (np.cumsum(n) - n), n)
        scores = np.bincount(self.doc[at], self.weight[at], len(used))
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


class Packer:
    """Takes shards of documents and gives pieces: (document's row, start, length, sequence, offset)."""

    def __init__(self) -> None:
        self.sequence, self.fill, self.open = 0, 0, []  # open: (row, start, length) of the window that is being filled

    def pieces(self) -> Iterator[tuple]:
        """Closes the open window."""
        at = 0
        for row, start, length in self.open:
            yield row, start, length, self.sequence, at
            at += length
        self.sequence, self.fill, self.open = self.sequence + 1, 0, []

    def _put(self, row, start: int, length: int) -> Iterator[tuple]:
        """Appends a piece that fits, and closes the window when it is full."""
        self.open.append((row, start, length))
        self.fill += length
        if self.fill == WINDOW:
            yield from self.pieces()

    def pack(self, rows: list, ids: list[np.ndarray], corpus: Corpus) -> Iterator[tuple]:
        index, used, sizes = Shard(ids, corpus), np.zeros(len(ids), bool), list(map(len, ids))
        cursor, seed, start = 0, None, 0  # seed: the document being laid down, from start on
        while True:
            if seed is None:
                while cursor < len(ids) and used[cursor]:
                    cursor += 1
                if cursor == len(ids):
                    return
                seed, start = cursor, 0
                used[seed] = True
            while sizes[seed] - start >= WINDOW - self.fill:  # up to the brim
                part = WINDOW - self.fill
                yield from self._put(rows[seed], start, part)
                start += part
                if start == sizes[seed]:
                    break
            if start == sizes[seed]:
                seed = None
                continue
            yield from self._put(rows[seed], start, sizes[seed] - start)
            cut = None
            for d in index.neighbours(seed, used):
                if sizes[d] <= WINDOW - self.fill:
                    used[d] = True
                    full = sizes[d] == WINDOW - self.fill
                    yield from self._put(rows[d], 0, sizes[d])
                    if full:
                        cut = None
                        break
                elif cut is None:
                    cut = d
            seed, start = cut, 0
            if seed is not None:
                used[seed] = True

    def close(self) -> Iterator[tuple]:
        """The open window as sequences of powers of two, largest first."""
        rest, self.open, left = self.open, [], self.fill
        self.fill = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                row, start, length = rest[0]
                part = min(room, length)
                self.open.append((row, start, part))
                room -= part
                rest = rest[1:] if part == length else [(row, start + part, length - part), *rest[1:]]
            yield from self.pieces()


def tokenised(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n, key, place, counts), a table: for each of docs(doc_id, text) its ids as 16-bit integers; for each task a row without ids, with the number of its documents that have each id."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, counts, place, doc_type = load(json_path, ranks_path, pattern), np.zeros(VOCABULARY, np.int32), 0, None
        begin = (c.partitionId() if (c := TaskContext.get()) else 0) << 36
        names = ["doc_id", "ids", "n", "key", "place", "counts"]
        for batch in blocks(batches):
            doc_type, ids, keys = batch.column("doc_id").type, tokenizer.encode_block(batch.column("text")), []
            for each in ids:
                seen = np.unique(each)
                counts[seen] += 1
                keys.append(shard_key(seen))
            n = len(ids)
            columns = [batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(map(len, ids), pa.int64()), pa.array(keys, pa.int64()), pa.array(np.arange(n) + (begin + place)), pa.nulls(n, pa.list_(pa.int32()))]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names)
        if place:
            nothing = [pa.nulls(1, t) for t in (doc_type, pa.binary(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([counts.tolist()], pa.list_(pa.int32()))], names)

    return checkpointed(docs.mapInArrow(run, f"doc_id {kind}, ids binary, n bigint, key bigint, place bigint, counts array<int>"))


def corpus_of(rows: DataFrame) -> Corpus:
    """From tokenised(); no more rows come to the driver than the vocabulary has ids."""
    n, tokens = rows.where("ids IS NOT NULL").agg(F.count(F.lit(1)), F.sum("n")).first()
    frequencies = np.zeros(VOCABULARY, np.int64)
    counts = rows.where("ids IS NULL").select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    for id_, count in counts.collect():
        frequencies[id_] = count
    return Corpus(n, frequencies, tokens or 0)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and their ids if wanted."""
    rows = tokenised(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), json_path, ranks_path, pattern)
    corpus, kind = corpus_of(rows), dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        partition = (c.partitionId() if (c := TaskContext.get()) else 0) << 40

        def given(pieces: Iterator[tuple]) -> pa.RecordBatch:
            rows = list(pieces)
            parts = [doc[1][s : s + n] for doc, s, n, _, _ in rows]
            columns = {
                "doc_id": pa.array([r[0][0] for r in rows], doc_type),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                "doc_tokens": pa.array([len(r[0][1]) for r in rows], pa.int64()),
                "sequence_id": pa.array([partition + r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
            if with_ids:
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32))
            return pa.RecordBatch.from_pydict(columns)

        shard, tokens, doc_type = [], 0, pa.int64()
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, np.uint16)
                shard.append((doc, ids))
                tokens += len(ids)
                if len(shard) == SHARD_DOCUMENTS or tokens >= SHARD_TOKENS:
                    yield given(packer.pack(shard, [r[1] for r in shard], corpus))
                    shard, tokens = [], 0
        if shard:
            yield given(packer.pack(shard, [r[1] for r in shard], corpus))
        if packer.open:
            yield given(packer.close())

    columns = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    # as many ranges as Spark is set to, and more of them where they would be larger than TASK_BYTES
    needed = -(-2 * corpus.tokens // TASK_BYTES)
    more = [needed] if needed > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = rows.where("ids IS NOT NULL").select("doc_id", "ids", "key", "place").repartitionByRange(*more, "key", "place").sortWithinPartitions("key", "place")
    return ordered.select("doc_id", "ids").mapInArrow(run, columns)
