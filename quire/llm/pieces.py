"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes words: runs of the space mark with what follows up to the next mark. No piece of the
vocabulary has a mark after another character (checked on loading), so merges never cross words, and
equal words have equal ids. Where no piece has a letter beside another character of ASCII (checked too) words are cut between those,
as fewer and shorter ones are distinct then. The distinct words of a block of texts are encoded together: their symbols
lie in one flat array, and each round finds, for every word at once, the least rank among its
adjacent pairs, merges the leftmost pair of that rank in each word, and compacts the array, until
no pair is left. Where no later pair could come in between ("safe" pieces: none that a piece of lower
rank could be made from), all pairs of the rank in a word merge in the same round, leftmost first. So do those
that stand so far behind the pair before that no piece reaches from what one becomes to what the other does.

The state kept between blocks is a table of words of bounded size, as Arrow arrays, from which the ids and texts of a block are
taken; words that the fewest blocks had make room for new ones. No text is cut.

Defined results: a null or empty text has the end id alone and decodes to an empty text; repeated
rows give the same; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordTable, blocks, cut, joined, offsets

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose encoding a worker keeps.
KEPT_WORDS = 200_000
#: Parts of words that are merged at once, so that their arrays stay in a core's cache.
PARTS = 16_384
NONE = np.iinfo(np.int32).max
SLOT_BITS = 19
#: By byte of UTF-8, for bytes.translate: 1 for letters of ASCII, 2 for the first of two bytes from U+00C0 on, 4 for other ASCII, 8 for the first of a mark, else 0.
KINDS = bytes((1 if chr(b).isalpha() else 4) if b < 0x80 else 2 if 0xC3 <= b < 0xE0 else 8 * (b == MARK.encode()[0]) for b in range(256))


def _meet(pair: str) -> bool:
    """Whether a letter, or what else has two bytes from U+00C0 on, stands beside another character of ASCII."""
    kinds = {c.isalpha() if c.isascii() else True if 0xC0 <= ord(c) < 0x800 else None for c in pair}
    return kinds == {True, False}


def _slot(keys: np.ndarray, table: int) -> np.ndarray:
    """Where each key has its slot in a table of 2**SLOT_BITS."""
    return (keys.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table % 2] + 2 * table) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """Encodes as the model at `path` does, if that is BPE without normalisation and with a mark put before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ｂ\t") != f"{MARK}{MARK}a{MARK}{MARK}ｂ\t":
            raise ValueError("the model normalises texts, which isn't supported")
        self.size = model.get_piece_size()
        self.end = model.eos_id()
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        plain = {t: i for i, t in enumerate(self.texts) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(MARK in t.lstrip(MARK) for t in plain):
            raise ValueError("a piece has a space mark inside")
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if model.is_byte(i)}
        self.raw_byte = {i: b for b, i in self.bytes.items()}
        self.raw = frozenset(self.raw_byte)
        self.shown = [t.replace(MARK, " ") if t in plain else "" for t in self.texts]
        self.single = {t: i for t, i in plain.items() if len(t) == 1}
        scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        ranks = {i: rank[model.get_score(i)] for i in plain.values()}
        shared = {r for r, n in zip(*np.unique(list(ranks.values()), return_counts=True)) if n > 1}
        pairs, unsafe = [], {i for i, r in ranks.items() if r in shared}
        for text, i in plain.items():
            for k in range(1, len(text)):
                left, right = plain.get(text[:k]), plain.get(text[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.size + right, ranks[i], i))
                    unsafe |= {x for x in (left, right) if ranks[x] >= ranks[i]}
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        self.slots, rest = [], np.arange(len(self.keys), dtype=np.int32)  # those whose slot another has are in the next table
        while len(rest):
            slots = np.zeros(1 << SLOT_BITS, np.int32)
            slot = _slot(self.keys[rest], len(self.slots))
            slots[slot] = rest
            self.slots.append(slots)
            rest = rest[slots[slot] != rest]
        self.safe = np.ones(self.size, bool)
        self.safe[list(unsafe)] = False
        self.reach = 2 * max(map(len, plain)) + 2
        self.inside = {t[k : k + 2] for t in plain for k in range(len(t) - 1)}
        self.letters = not any(map(_meet, self.inside))
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        for t, i in self.single.items():
            self.chars[ord(t)] = i
        self.numbers = pa.array([f"{i} " for i in range(self.size)], pa.large_string())
        self.stands_for = pa.array([bytes([self.raw_byte[i]]) if i in self.raw else t.encode() for i, t in enumerate(self.shown)], pa.large_binary())
        #: Of words: the number of ids, them in decimal with a space after each, and what they stand for.
        self.table = WordTable(pa.int64(), pa.large_string(), pa.large_string())

    @property
    def words(self) -> list[str]:
        return self.table.words.to_pylist()

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        ids, ends = self._ids(words)
        ids, ends = ids.tolist(), ends.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's end."""
        texts, counts, copied = [], np.ones(len(words), np.int64), 0  # parts of words that no piece spans, and how many each word has
        for w in [w for w, n in enumerate(map(len, words)) if n > 24]:
            texts += words[copied:w]
            copied, before, word, at = w + 1, len(texts), words[w], 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in self.inside:
                    texts.append(word[at:i])
                    at = i
            texts.append(word[at:])
            counts[w] = len(texts) - before
        texts += words[copied:]
        ends = np.cumsum(counts)
        done = [self._merged(texts[i : i + PARTS]) for i in range(0, len(texts), PARTS)]
        symbols, counts = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*done)) if done else (np.empty(0, np.int64), ends)
        if len(symbols) and symbols.min() < 0:
            symbols, counts = self._as_bytes(symbols, counts)
        return symbols, np.append(0, np.cumsum(counts))[ends]

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all parts one after another, and how many each has; -1 - c for a character c that isn't a piece."""
        symbols = self.chars[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        part = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
        whole, place, left = part, np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), bool)
        done = np.empty(len(symbols), np.int64)  # each symbol at its first character's place, where `left` says so
        rank, into = self._ranked(symbols, part, np.arange(max(0, len(symbols) - 1)))
        rank, into = np.append(rank, NONE), np.append(into, np.int32(0))  # of each symbol with the one after it
        while len(symbols):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            busy = least < NONE
            if not busy.all():
                at = place[~busy]
                done[at], left[at] = symbols[~busy], True
            hit = np.flatnonzero(busy & (rank == least))
            if not len(hit):
                break
            fresh = np.append(True, part[hit[1:]] != part[hit[:-1]])  # the leftmost of each part
            first = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1) | fresh)
            offset = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
            far = np.append(True, hit[1:] - hit[:-1] >= self.reach)
            take = hit[fresh | far | (self.safe[into[hit]] & (offset % 2 == 0))]
            symbols[take] = into[take]
            busy[take + 1] = False
            moved = np.cumsum(busy) - 1
            symbols, part, place, rank, into = symbols[busy], part[busy], place[busy], rank[busy], into[busy]
            at = moved[take]
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at], into[at] = NONE, 0
            at = at[at < len(symbols) - 1]
            rank[at], into[at] = self._ranked(symbols, part, at)
        return done[left], np.bincount(whole[left], minlength=len(texts))

    def _as_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that aren't pieces as the pieces of their bytes in UTF-8."""
        other = np.flatnonzero(symbols < 0)
        codes = -1 - symbols[other]
        sizes = np.ones(len(symbols), np.int64)
        sizes[other] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.repeat(symbols, sizes)
        raw = np.frombuffer("".join(map(chr, codes.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out[out < 0] = np.array([self.bytes.get(b, -1) for b in range(256)], np.int64)[raw]
        ends = np.cumsum(counts)
        total = np.append(0, np.cumsum(sizes))[ends]
        return out, np.diff(total, prepend=0)

    def _ranked(self, symbols: np.ndarray, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair that begins at `at`; NONE and any piece where there is no merge."""
        left, right = symbols[at], symbols[at + 1]
        key = left.astype(np.int64) * self.size + right
        found = self.slots[0][_slot(key, 0)]
        good = (part[at] == part[at + 1]) & (left >= 0) & (right >= 0)
        for k in range(1, len(self.slots)):
            miss = np.flatnonzero(good & (self.keys[found] != key))
            found[miss] = self.slots[k][_slot(key[miss], k)]
        good &= self.keys[found] == key
        return np.where(good, self.ranks[found], NONE), self.merged[found]

    def decode_raw(self, ids: list[int]) -> str:
        """What ids stand for, with marks as spaces; a space that a text's own mark gives at its very start isn't taken off."""
        if not self.raw.isdisjoint(ids):
            out, pending = [], bytearray()
            for i in ids:
                if i in self.raw:
                    pending.append(self.raw_byte[i])
                    continue
                out += [pending.decode("utf-8", "replace"), self.shown[i]]
                pending.clear()
            return "".join(out) + pending.decode("utf-8", "replace")
        return "".join([self.shown[i] for i in ids])

    def learn(self, words: Iterable[str] | pa.LargeStringArray) -> np.ndarray:
        """Has all of distinct words in the table and gives their rows in it."""
        return self.table.rows(words if isinstance(words, pa.Array) else pa.array(list(words), pa.large_string()), self._values, KEPT_WORDS)

    def _values(self, words: list[str]) -> tuple[pa.Array, ...]:
        ids, ends = self._ids(words)
        return pa.array(np.diff(ends, prepend=0)), *(joined(a.take(pa.array(ids)), ends) for a in (self.numbers, self.stands_for))

    def parts(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Of a block of texts, parts that no piece spans, and how many there are up to each text's last: words, cut where letters meet other characters if no piece has both."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), " ", MARK)
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        return cut(texts, self._begins)

    def _begins(self, data: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(data) + 3, bool)  # from 3 on: whether a mark begins there
        kind = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
        mark[3:-2] = (kind[:-2] == 8) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = mark[3:] & ~mark[:-3]
        if self.letters:
            other, starts = kind == 4, kind == 2
            letter = (kind == 1) | starts
            last = kind == 1  # whether a letter's last byte is there
            last[1:] |= starts[:-1]
            begins[1:] |= other[1:] & last[:-1] | letter[1:] & other[:-1]
        return begins

    def split(self, text: str) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """The ids of one text and the end id."""
        return [i for ids in self.merge(self.split(text)) for i in ids] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids in decimal, joined by a space, the end id last."""
    return _encoded(docs, model_path, id_column, text_column, "ids string, decoded string", lambda *parts: b"".join(parts).decode("utf-8"))


def digests(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def sha(first: memoryview, rest: bytes = b"") -> str:
        digest = hashlib.sha256(first)
        digest.update(rest)
        return digest.hexdigest()

    return _encoded(docs, model_path, id_column, text_column, "ids_sha256 string, decoded_sha256 string", sha)


def _encoded(docs: DataFrame, model_path: str, id_column: str, text_column: str, columns: str, give) -> DataFrame:
    kind = dict(docs.dtypes)[id_column]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        last = str(model.end).encode()
        for batch in blocks(batches):
            parts, ends = model.parts(batch.column("text"))
            rows = model.learn(parts.dictionary)[parts.indices.to_numpy()]
            sizes, *texts = (a.take(pa.array(rows)) for a in model.table.columns)
            counts = np.append(0, np.cumsum(sizes.to_numpy()))[ends]
            ids, decoded = (joined(a, ends) for a in texts)
            out = []
            for column in (ids, decoded):
                at, data = offsets(column).tolist(), memoryview(column.buffers()[2])
                if column is ids:
                    out.append([give(data[a:b], last) for a, b in zip(at, at[1:])])
                else:  # without the space of the mark before each text
                    out.append([give(data[a + (data[a:b][:1] == b" ") : b]) for a, b in zip(at, at[1:])])
            counts = np.diff(counts, prepend=0) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(o, pa.string()) for o in out)], ["doc_id", "n_tokens", *names])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {columns}")
