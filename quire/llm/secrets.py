"""Secret scans: fixed token formats, and a guess-cost estimate for values in a credential context.

The cost of guessing a value is the smallest sum, over all ways to cut it into spans, of log10 of the
guesses each span takes: words by their rank, dates, repeats of one character, walks along keyboard
rows or the alphabet, and brute force by character for what remains. Words are ranked by the number of the corpus' documents that
have them, the DICTIONARY most common ones (a bound on the model), after a short list of common passwords. Every value that follows a
credential word and costs STRONG or more is a secret of kind "guess", whole, also where base spans hold it or end within it;
"changeme2024" costs little and isn't one. Spans that overlap are redacted as one.

Defined results: a null text counts as empty, and an empty one has no span; but for the words' ranks spans don't depend on
other rows, so ties and repeated rows are scanned alike, and an empty table leaves the short list; the cost takes time in proportion to the
value's length, so very long values are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blocks, checkpointed, discard, lower_ascii

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value is taken for a real secret.
STRONG = 10.0

#: Letters from which a value is no longer taken for a word of prose.
LONGEST_WORD = 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# the least length can stand in these two, as a run that is too short is so from any of its characters
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:passphrase|password|passwd|passcode|pass|pwd|secret|token|bearer|credentials?|api[_-]?key|private[_-]?key|access[_-]?key|login)["']?\x20*(?:is\x20|[:=])\x20*["']?([^\s"'`<>,;()\[\]{}|]{8,})""", re.I | re.A)

# Common words of passwords, most common first.
WORDS = """password admin welcome login master secret dragon monkey shadow sunshine princess football baseball letmein
hello iloveyou summer winter spring autumn freedom whatever trustno ninja mustang access superman batman hunter
charlie michael jordan thomas robert daniel andrew jessica ashley jennifer amanda nicole michelle matthew hockey
soccer killer pepper ginger cookie banana orange purple yellow silver golden diamond flower computer internet
server database system network service default changeme example sample test user root guest public private
token key pass word demo temp null none true false your insert here placeholder redacted""".split()
#: Words of the corpus that are ranked, and the most letters such a word has.
DICTIONARY, MOST_LETTERS = 20_000, 30
#: So many times as many words as are ranked are looked at in the end.
SHARES = 50
# Rows of keys, and the orders that are typed as such.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
#: After a key, each row and direction in which another key follows.
NEXT: dict[tuple[str, str], frozenset[int]] = {}
for _k, _row in enumerate(w for row in ROWS for w in (row, row[::-1])):
    for _pair in zip(_row, _row[1:]):
        NEXT[_pair] = NEXT.get(_pair, frozenset()) | {_k}
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
#: Added for each span, as how a value is cut must be guessed too.
CUT = log10(2)


def _alphabet(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


class Guesser:
    """Costs of values, given words from the most common to the least, which come after WORDS. A repeat of one character is no word."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *words):
            if len(set(w)) > 1:
                self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        # a span that begins before a run of one character ends within so many of the run's
        self.reach = max(self.longest, *map(len, ROWS), 10)
        self.cost = lru_cache(4096)(self._cost)

    def _cost(self, value: str) -> float:
        """log10 of the guesses for the cheapest way to cut value into spans; 0 for an empty one."""
        n, plain = len(value), "".join([low if len(low := c.lower()) == 1 else c for c in value])
        leet = plain.translate(LEET)
        ending: dict[int, list[int]] = {}
        if any(map(str.isdigit, value)):
            for i in range(n):
                if m := DATE.match(plain, i):
                    ending.setdefault(m.end(), []).append(i)
        same, walks = [0] * n, [{}] * n  # where the run that holds a character began; and the walks, by row and direction
        for i in range(1, n):
            same[i] = same[i - 1] if value[i] == value[i - 1] else i
            walks[i] = {k: walks[i - 1].get(k, i - 1) for k in NEXT.get((plain[i - 1], plain[i]), ())}
        best, forced = [0.0] * (n + 1), [0.0] * (n + 1)  # forced: of cuts whose last span is brute force
        for j in range(1, n + 1):
            c = value[j - 1]
            forced[j] = min(best[j - 1] + CUT, forced[j - 1] if j > 1 else CUT) + _alphabet(c)
            cost = forced[j]
            for i in range(max(0, j - self.longest), j - 2):
                for form, extra in ((plain, 0.0), (leet, 0.5)):
                    if rank := self.rank.get(form[i:j]):
                        cased = 0.0 if value[i:j].islower() else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                        cost = min(cost, best[i] + CUT + log10(1 + rank) + cased + extra)
            # a run is cheapest from where the last span that isn't all of the run's character ends
            for i in range(same[j - 1], min(same[j - 1] + self.reach, j - 3) + 1):
                cost = min(cost, best[i] + CUT + _alphabet(c) + log10(j - i))
            if walks[j - 1]:
                for i in range(min(walks[j - 1].values()), j - 2):
                    cost = min(cost, best[i] + CUT + log10(2 * sum(map(len, ROWS))) + log10(j - i))
            for i in ending.get(j, ()):
                cost = min(cost, best[i] + CUT + log10(365 * 100 if j - i > 4 else 200))
            best[j] = cost
        return best[n]


PLAIN = Guesser()


def dictionary(docs: DataFrame, text_column: str = "text", most: int = DICTIONARY) -> list[str]:
    """The words that the most documents have, most common first and by the alphabet where equal; counted over all texts.

    Only words that make up 1 / (SHARES * most) of what is counted are put in order, of which there can't be more than SHARES * most, however large the corpus.
    """
    words = F.filter(F.array_distinct(F.split(lower_ascii(F.col(text_column)), "[^a-z]+")), lambda w: F.length(w).between(3, MOST_LETTERS))
    counts = checkpointed(docs.select(F.explode(words).alias("word")).groupBy("word").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    common = counts.where(F.col("count") * (SHARES * most) >= total)
    found = [r["word"] for r in common.orderBy(F.desc("count"), "word").limit(most).collect()]
    discard(counts)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guessed_spans(text: str, guesser: Guesser = PLAIN, strong: float = STRONG) -> list[tuple[int, int, str]]:
    """Values in a credential context that are hard to guess, whole. One word after "is" is taken for prose."""
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        start = m.start(1)
        if len(value) >= 8 and not (_word(value) and not re.search("[:=]", text[m.start() : start])) and guesser.cost(value) >= strong:
            found.append((start, start + len(value), "guess"))
    return found


def _word(value: str) -> bool:
    """Letters that can be one word of prose: not too many, and capitals at the start or throughout if at all."""
    return value.isalpha() and len(value) <= LONGEST_WORD and (value[1:] == value[1:].lower() or value == value.upper())


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(text: str | None, guesser: Guesser = PLAIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + guessed_spans(text, guesser), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each of docs: counts and a digest of the base spans, all spans, and the largest guess cost of a value assigned or guessed (null: none)."""
    kind, words = dict(docs.dtypes)[id_column], dictionary(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words)
        for batch in blocks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = _scan(text, guesser)
                kinds = [k for _, _, k in base]
                costs = [guesser.cost(ASSIGN.match(text, s)[2] if k == "assign" else text[s:e]) for s, e, k in spans if k in ("assign", "guess")]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), max(costs, default=None)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "guess_cost"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, guess_cost double")


def redact_text(text: str | None, mark: str = "[{}]", guesser: Guesser = PLAIN) -> str | None:
    """text with each secret replaced; of an assignment the name stays. Spans that overlap are replaced together."""
    if not text:
        return text
    _, spans = _scan(text, guesser)
    if not spans:
        return text
    cut = sorted((ASSIGN.match(text, s).start(2) if k == "assign" else s, KINDS.index(k), e) for s, e, k in spans)
    parts, at = [], 0
    for start, kind, end in cut:
        if start >= at:
            parts += [text[at:start], mark.format("secret" if KINDS[kind] in ("assign", "guess") else KINDS[kind])]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the secrets in its texts replaced, and n_chars, if there, counted anew; all rows stay, so an empty table gives an empty one."""
    words = dictionary(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(words)
        for batch in blocks(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            texts = pa.array([redact_text(t, guesser=guesser) for t in batch.column(at).to_pylist()], pa.string())
            batch = batch.set_column(at, text_column, texts)
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, "n_chars", pc.utf8_length(texts).cast(batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
