"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint has bit i set where over half of a text's shingles have it in their hash. Fingerprints
are cut into segments, and each has a table (segment, value). A fingerprint looks up every value in a
small Hamming ball about each of its segments; what it finds there counts as a link when the
complete distance is small enough. With radii as `exact_radii` gives them no pair within the
distance is missed.

With two segments, a bucket with over HOT fingerprints isn't joined as it stands: its members are looked up by the
other segment's ball as well, so that a group of near copies costs a fixed number of lookups per member and
not the square of its size. That second key makes the complete fingerprint and the
second radius is the complete distance, so nothing is lost; an index where it could lose a pair is joined as it stands.

Equal fingerprints are one node from the start, so copies never meet each other in a join.

Defined results: a null or empty text, or one of white space, has fingerprint zero; null ids take no
part in the smallest id of a component (null if there is no other); repeated rows are kept; an empty
table gives an empty result; only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_BYTES, blocks, checkpointed, discard, release, spread_join
from quire.llm.graph import components

#: Fingerprints in a bucket from which its members are looked up by a second segment too, where that loses nothing.
HOT = 256


@dataclass(frozen=True)
class Index:
    """words: 64-bit words of a fingerprint. Segment k has the `width` bits from bit k * width on; radii: of the ball about each."""

    shingle: int = 3
    words: int = 1
    width: int = 32
    radii: tuple[int, ...] = (1, 0)
    distance: int = 2
    second_radius: int = 2


def exact_radii(distance: int, segments: int) -> tuple[int, ...]:
    """The smallest radii with which no pair of the distance is missed: were all of them exceeded, the distance would be too."""
    a = distance // segments
    return tuple(a if k <= distance - segments * a else a - 1 for k in range(segments))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the result depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of `shingle` words, as often as it stands there; of all words where they are fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        parts = [joined]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(tokens) - shingle + 1].tolist()
        parts = [joined[s:e] for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(p, 42) for p in parts]), ">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int, words: int) -> np.ndarray:
    """`words` unsigned 64-bit integers, the first from the shingles' XXH64 with seed 42, the others from what it is mixed to."""
    return _voted(shingles(text, shingle), words)


def _voted(hashes: np.ndarray, words: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(words, np.uint64)
    out = np.empty(words, np.uint64)
    for w in range(words):
        h = _mixed(hashes + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if w else hashes
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[w] = np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.uint32) > len(hashes)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, index: Index = Index(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): the words of each text's fingerprint as bigint."""
    shingle, words = index.shingle, index.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = np.array([fingerprint(t, shingle, words) for t in batch.column("text").to_pylist()]).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, w]) for w in range(words))], ["doc_id", *(f"f{w}" for w in range(words))])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"f{w} bigint" for w in range(words)))


def _segment(index: Index, k: int) -> Column:
    word, low = divmod(k * index.width, 64)
    if low + index.width > 64:  # over two words
        part = F.shiftrightunsigned(F.col(f"f{word}"), low).bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - low))
    else:
        part = F.shiftrightunsigned(F.col(f"f{word}"), low)
    return part.bitwiseAND(F.lit((1 << index.width) - 1))


def _masks(width: int, radius: int) -> Column:
    """Every non-zero difference within the radius."""
    return F.array(*(F.lit(sum(1 << b for b in bits)).cast("bigint") for r in range(1, radius + 1) for bits in combinations(range(width), r)))


def _lookups(index: Index, k: int, radius: int, both: bool) -> Column:
    """The values to look up about segment k. A pair of unlike values is looked up from the smaller one only, unless both."""
    own = _segment(index, k)
    if not radius:
        return F.array(own)
    near = F.transform(_masks(index.width, radius), lambda m: own.bitwiseXOR(m))
    return F.concat(F.array(own), near if both else F.filter(near, lambda v: v > own))


def _keyed(values: Column, segment: int, key: str, moved: str) -> Column:
    """Each value as a key that holds the segment too; moved: whether it isn't the segment's own, which comes first."""
    return F.transform(values, lambda x, i: F.struct((x + F.lit(segment << 40)).alias(key), (i > 0).alias(moved)))


def links(nodes: DataFrame, index: Index) -> DataFrame:
    """(a, b), a pair of nodes(node, f0, ...) once: all found within index.distance of each other.

    Only nodes' ids travel with the keys; complete fingerprints are joined to the pairs that met.
    """
    names = [f"f{w}" for w in range(index.words)]
    segments = range(len(index.radii))

    def exploded(rows: DataFrame, keys, key: str, moved: str, *more: str) -> DataFrame:
        return rows.select("node", *more, F.explode(F.concat(*(_keyed(keys(k), k, key, moved) for k in segments))).alias("e")).select("node", *more, f"e.{key}", f"e.{moved}")

    entries = exploded(nodes, lambda k: F.array(_segment(index, k)), "key", "moved")
    probes = exploded(nodes, lambda k: _lookups(index, k, index.radii[k], False), "key", "moved")
    complete = len(index.radii) == 2 and index.second_radius >= index.distance
    hot = checkpointed(entries.groupBy("key").count().where(F.col("count") > HOT).select("key")) if complete else None

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        right = right.select(*on, F.col("node").alias("other"))
        # a pair of equal values is met from both sides, one of unlike values from one
        pairs = left.join(right, on).where((F.col("node") < F.col("other")) | ((F.col("node") > F.col("other")) & F.col("moved")))
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    if hot is None or hot.isEmpty():
        found = met(probes, entries, ["key"])
    else:
        found = met(probes.join(hot, "key", "left_anti"), entries.join(hot, "key", "left_anti"), ["key"])
        own = lambda rows: rows.join(hot, "key").join(nodes, "node")
        again = F.shiftright("key", 40) != F.shiftright("second", 40)
        left = exploded(own(probes), lambda k: _lookups(index, k, index.second_radius, True), "second", "_moved", "key", "moved").where(again)
        right = exploded(own(entries.drop("moved")), lambda k: F.array(_segment(index, k)), "second", "_moved", "key").where(again)
        found = found.union(met(left, right, ["key", "second"]))
    of = lambda c, sign: nodes.select(F.col("node").alias(c), *(F.col(n).alias(f"{sign}{i}") for i, n in enumerate(names)))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(index.words)))
    return found.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").where(apart <= index.distance).select("a", "b")


def near_duplicates(docs: DataFrame, index: Index = Index(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f0, ..., component_id): component_id is the smallest doc_id that links reach."""
    names = [f"f{w}" for w in range(index.words)]
    node = F.col("f0") if index.words == 1 else F.xxhash64(*names)
    prints = checkpointed(fingerprints(docs, index, id_column, text_column).withColumn("node", node))
    nodes = checkpointed(prints.groupBy("node", *names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.drop("first", "n"), index))
    of = checkpointed(nodes.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")))
    least = checkpointed(of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    of = checkpointed(spread_join(of, least, ["root"], "nodes").select("node", "n", "component_id"))
    return spread_join(prints, of, ["node"], "n").select("doc_id", *names, "component_id")


def hexadecimal(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


#: For near copies with a Jaccard similarity of 0.8 or more over five-word shingles. Four segments of radius 1 miss no pair within 7 of the
#: first 128 bits and few of Jaccard 0.97; near_copies() finds the rest by shingles. Fingerprints that differ in more than `distance` of 512 bits
#: aren't of two sets of Jaccard 0.8: 78 to 96 bits differ then on average, with a standard deviation under 9. It holds for texts that repeat no
#: shingle; others are always counted out.
NEAR_COPIES = Index(shingle=5, words=8, width=32, radii=(1,) * 4, distance=150)
#: So many of the most common shingles come last in the order, as far as over COMMON of the texts in a sample of 1 in SAMPLE
#: have them. The order decides how many texts meet, not which are linked.
MOST_COMMON, COMMON, SAMPLE = 200_000, 2, 16
#: Of them, those whose buckets are led without a shuffle of all their texts.
HOT_SHINGLES = 10_000


def _prefix(distinct: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in one order of all: two sets of Jaccard 0.8 or more share one of them, among the first ninth of the smaller set. distinct and common are sorted."""
    n = len(distinct)
    late = np.zeros(n, bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, distinct), len(common) - 1)] == distinct
    return np.concatenate([distinct[~late], distinct[late]])[: n + 1 - (4 * n + 4) // 5]


#: Bits of each of the two maps that bound how many shingles two sets share.
MAP_BITS = 512
MAPS = [f"m{i}" for i in range(MAP_BITS // 32)]


def _maps(distinct: np.ndarray) -> tuple[np.ndarray, int]:
    """Which hash cells have a shingle, and which have two, as 64-bit words, one map after the other; and the number of shingles beyond two in their cells.

    Two sets share at most as many shingles as their first maps have cells in common, and their second, and the lesser number beyond.
    """
    cells = np.bincount((_mixed(distinct) >> np.uint64(55)).astype(np.int64), minlength=MAP_BITS)
    bits = np.concatenate([np.packbits(cells > 0), np.packbits(cells > 1)])
    return bits.view(np.int64), int(np.maximum(cells - 2, 0).sum())


def _sketches(docs: DataFrame, index: Index, common: np.ndarray) -> DataFrame:
    """(row, doc_id, node, f0, ..., m0, ..., beyond, n, plain, keys) of docs(row, doc_id, text); node: equal for equal fingerprints and sets of shingles; plain: none is repeated; keys: for the first row of a node in each task."""
    words = index.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in blocks(batches):
            nodes, prints, sizes, plain, keys, maps = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, index.shingle)
                found, distinct = _voted(hashes, words), np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes() + distinct.tobytes()))
                keys.append((_prefix(distinct, common) if nodes[-1] not in seen else distinct[:0]).view(np.int64))
                seen.add(nodes[-1])
                prints.append(found)
                maps.append(_maps(distinct))
                sizes.append(len(distinct))
                plain.append(len(distinct) == len(hashes))
            found = np.array(prints).reshape(-1, words).view(np.int64)
            words_of = np.array([m for m, _ in maps]).reshape(-1, len(MAPS))
            bounds = [*(pa.array(words_of[:, i]) for i in range(len(MAPS))), pa.array([b for _, b in maps], pa.int64())]
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), *(pa.array(found[:, w]) for w in range(words)), *bounds, pa.array(sizes, pa.int64()), pa.array(plain, pa.bool_()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", *(f"f{w}" for w in range(words)), *MAPS, "beyond", "n", "plain", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"row string, doc_id {kind}, node bigint, " + ", ".join(f"{c} bigint" for c in [*(f"f{w}" for w in range(words)), *MAPS, "beyond"]) + ", n bigint, plain boolean, keys array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *arrays]))


def _common(docs: DataFrame, index: Index) -> np.ndarray:
    """The most common shingles of a sample of docs(content, text), most common first. An executor ranks them; the driver gets no more than these, as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys = [np.unique(shingles(t, index.shingle)) for t in batch.column("text").to_pylist()]
            key, n = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    sample = docs.where(F.pmod("content", F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    most = checkpointed(counts.where(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON))
    got = most.toArrow()
    discard(most)
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    return key[np.lexsort((key, -n))].view(np.uint64)


def _row(id_column: str, text_column: str) -> Column:
    """What rows of equal id and text, and no others, have in common."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.md5(F.concat(part(id_column), F.lit("\n"), part(text_column)).cast("binary"))


def _grouped(docs: DataFrame, index: Index, id_column: str, text_column: str) -> DataFrame:
    """(row, doc_id, root): the component of each row of docs, as near_copies() links them; a table."""
    docs = docs.select(_row(id_column, text_column).alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("content"), F.col(text_column).alias("text"))
    names = [f"f{w}" for w in range(index.words)]
    common = _common(docs, index)
    release(docs.sparkSession)
    sketches = checkpointed(_sketches(docs.select("row", "doc_id", "text"), index, np.sort(common)))
    prints = checkpointed(sketches.drop("keys"))
    # all rows of a node have the same shingles; row: the one whose text stands for it
    heads = checkpointed(prints.groupBy("node").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in (*names, *MAPS, "beyond", "n", "plain"))))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in names))
    of = lambda c: heads.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in (*names, *MAPS, "beyond", "n", "plain", "row")))
    shared = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a_{m}").bitwiseAND(F.col(f"b_{m}"))) for m in MAPS)) + F.least("a_beyond", "b_beyond")
    # two sets that share m of x + y - m shingles are alike when 9 m >= 4 (x + y); m is at most the smaller of both
    enough = lambda m, x, y: 9 * m >= 4 * (x + y)

    def measured(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) with both sides' rows and sizes and their complete distance, where that and the most shingles that they can share allow it."""
        met = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("apart", apart).where(enough(F.least("a_n", "b_n", shared), F.col("a_n"), F.col("b_n")))
        return met.where((F.col("apart") <= index.distance) | ~F.col("a_plain") | ~F.col("b_plain")).select("a", "b", "a_n", "b_n", "a_row", "b_row", "apart")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = [np.unique(shingles(t, index.shingle)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(sets)], ["row", "held"])

    def alike(pairs: DataFrame) -> DataFrame:
        """(a, b) of the measured pairs, a table, whose sets have a Jaccard similarity of 0.8 or more, counted out."""

        def sets(c: str) -> DataFrame:
            texts = docs.select("row", "text").join(checkpointed(pairs.select(F.col(f"{c}_row").alias("row")).distinct()), "row", "left_semi")
            return texts.mapInArrow(held, "row string, held array<bigint>").groupBy("row").agg(F.first("held").alias(f"{c}_held")).withColumnRenamed("row", f"{c}_row")

        # b first: a is the first of a bucket as a rule, and one for many
        both = pairs.join(sets("b"), "b_row").join(sets("a"), "a_row")
        return checkpointed(both.where(enough(F.size(F.array_intersect("a_held", "b_held")), F.col("a_n"), F.col("b_n"))).select("a", "b"))

    def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    # by segments: the first text of each bucket that a text looks up
    firsts = _looked_up(heads, index, False).groupBy("key").agg(F.min("node").alias("a"))
    stars = _looked_up(heads, index, True).join(firsts, "key").select("a", F.col("node").alias("b"))
    # by shingles: a bucket holds the texts that have one among their first, and is led by the first of them that has it in its first ninth
    entries = sketches.select("node", "n", F.posexplode("keys").alias("at", "key")).withColumn("early", 9 * F.col("at") <= F.col("n"))

    def led(rows: DataFrame) -> DataFrame:
        leads = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.when(F.col("early"), F.struct("node", "n", "at"))).alias("lead"))
        return leads.where("low < high AND lead IS NOT NULL").select("key", "lead")

    # the most common shingles, of which there are HOT_SHINGLES at most, are counted where they stand; all others travel once, and both sides of the join are at hand
    hot = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in common[:HOT_SHINGLES].view(np.int64).tolist()], "key bigint"))
    many, few = entries.join(hot, "key"), entries.join(hot, "key", "left_anti").repartition("key")
    members = many.join(F.broadcast(led(many)), "key").unionByName(few.join(led(few), "key"))
    members = checkpointed(members.groupBy("key", "node", "n", "at", "early").agg(F.first("lead").alias("lead")))
    discard(sketches)
    release(docs.sparkSession)
    # what both have from the shared shingle on is all that they can share, if it's the first they share
    reach = lambda x, y: enough(F.least(x["n"] - x["at"], y["n"] - y["at"]), x["n"], y["n"])
    whole = F.struct("n", "at")
    stars = stars.union(members.where(reach(whole, F.col("lead"))).select("lead.node", "node")).where("a <> b").distinct()
    # each text is counted out with the nearest of them, then what isn't in one component by then in pairs
    nearest = checkpointed(measured(stars).groupBy("b").agg(F.min_by(F.struct("a", "a_n", "b_n", "a_row", "b_row"), F.struct("apart", "a")).alias("s")).select("b", "s.*"))
    found = alike(nearest)
    release(docs.sparkSession)
    members = rooted(members.select("key", "node", "n", "at", "early"), found)
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = checkpointed(members.join(mixed, "key", "left_semi"))
    small = rest.where("early").select("key", F.struct("node", "n", "at", "root").alias("y"))
    pairs = rest.select("key", F.struct("node", "n", "at", "root").alias("x")).join(small, "key").where((F.col("x.root") != F.col("y.root")) & (F.col("x.n") >= F.col("y.n")) & reach(F.col("x"), F.col("y")))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = checkpointed(measured(pairs))
    if not pairs.isEmpty():
        found = found.union(alike(pairs))
    release(docs.sparkSession)
    roots = checkpointed(rooted(heads.select("node", "rows"), found))
    return checkpointed(spread_join(prints.select("row", "doc_id", "node"), roots, ["node"], "rows").select("row", "doc_id", "root"))


def _looked_up(nodes: DataFrame, index: Index, near: bool) -> DataFrame:
    """(node, key): each segment's own value as a key, and with near those about it too; a pair of unlike values meets from the smaller one only."""
    def keys(k: int) -> Column:
        values = _lookups(index, k, index.radii[k], False) if near else F.array(_segment(index, k))
        return F.transform(values, lambda v: v + F.lit(k << 40))

    return nodes.select("node", F.explode(F.concat(*(keys(k) for k in range(len(index.radii))))).alias("key"))


def near_copies(docs: DataFrame, index: Index = NEAR_COPIES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, component_id) as near_duplicates(), over links between all texts whose sets of shingles have an exact Jaccard similarity of 0.8 or more, and no others.

    Fingerprints find the close copies: each text looks up the Hamming balls about its segments, and meets the first text
    of each bucket it finds. No radius that can be looked up reaches all pairs of 0.8 (they differ in
    78 of 512 bits on average), so texts meet by the shingles that come first in one order of all, too (prefix and positional filter),
    which every pair of 0.8 does. Each text is compared with the nearest of the first texts it met, by the complete distance, and counted
    out exactly. Only texts that share a bucket and aren't in one component by then are compared in pairs, where sizes, places, the complete
    distance and maps of hash cells, which bound what two sets share, allow it. So a group of near copies costs few comparisons per text, and leads to the same components as all its pairs would.
    """
    rows = _grouped(docs, index, id_column, text_column)
    least = checkpointed(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return spread_join(rows, least, ["root"], "n").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, index: Index = NEAR_COPIES) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, a null id last, and the least hash of id and text where two texts share it.

    Rows of one id with unlike texts are in groups of their own. Of rows that are equal in id and text one stays, the one whose other columns have the least hash.
    """
    rows = _grouped(docs, index, "doc_id", "text")
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select("least.row")
    keep = checkpointed(keep.join(rows.groupBy("row").agg(F.count(F.lit(1)).alias("times")), "row"))
    whole = docs.select(_row("doc_id", "text").alias("row"), F.xxhash64(*docs.columns).alias("hash"), F.struct(*docs.columns).alias("of"))
    once = whole.join(keep.where("times = 1").select("row"), "row", "left_semi").select("of")
    several = whole.join(keep.where("times > 1").select("row"), "row", "left_semi").groupBy("row").agg(F.min_by("of", "hash").alias("of")).select("of")
    return once.union(several).select("of.*")
