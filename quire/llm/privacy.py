"""PII, and information-theoretic sanitisation of the terms that give it away.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, by pattern. How strongly a term (a word of
MIN_LETTERS letters or more) reveals an entity is estimated from counts of documents over the whole corpus, n of N: with
p(e) = n(e) / N and p(e|t) = (n(t, e) + p(e)) / (n(t) + 1), which is one pseudo-count at the entity's own rate, PMI(t; e) =
log2(p(e|t) / p(e)) against the entity's information IC(e) = -log2 p(e). A term whose PMI is at least DISCLOSURE of the
IC is a span of kind "term" wherever it stands in a document with that entity, outside of e-mail addresses. So a term that
stands in documents with the entity alone tells it, be the entity rare or common, and a common word never does; most
personal data stand in one document, which is why nothing asks for several. `sanitise` generalises entities to their kind
and takes such terms out.

DataFrame functions only. Spans come from the matches of a pattern and the texts between them, row by row, in time linear in
the matches. Entities that stand in the same documents have the same counts with every term, so they are one class, known by
their number of documents and the sum of those documents' hashes; terms are paired with a document's classes and not with
its entities, and only where n(t) is low enough for any n(t, e) to suffice. Keys that many rows share are joined by broadcast
(`common.spread_join`). The corpus' words are counted before they are joined.

Defined results: a null text counts as empty; null ids are ids like any other; a repeated row is a document more and gets the
same spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, lower_ascii, spread_join

KINDS = ("email", "ip", "card", "phone")
# The patterns asked for, written so that a run of characters is tried from its start alone (or from where the last
# match ended) and never again from within, and possessive, so that a run of any length takes no stack: what they find is the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text without such a match lacks.
GUARDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": "[+][0-9]"}
MIN_LETTERS, DISCLOSURE = 2, 0.9
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
CHUNK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def add(total: Column, i: Column) -> Column:
        x = turned.substr(i, F.lit(1)).try_cast("int")
        return total + F.when(i % 2 == 0, F.get(doubled, x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def matches(rows: DataFrame, text: str, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows with a column for each name of found (guard, pattern): the matches in column `text` as spans of kind name, with starts and ends in code points."""
    rows = rows.withColumns({f"_m_{n}": F.when(guard, F.regexp_extract_all(text, pattern, 0)) for n, (guard, pattern) in found.items()})
    rows = rows.withColumns({f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(F.col(text), p)) for n, (_, p) in found.items()})
    steps = lambda n: F.transform(f"_m_{n}", lambda m, i: F.length(m) + F.length(F.get(f"_g_{n}", i)))
    rows = rows.withColumns({f"_e_{n}": F.when(F.size(f"_g_{n}") > 0, running(steps(n), lambda a, x: a + x)) for n in found})

    def placed(name: str) -> Column:
        span = lambda m, e: F.struct(F.lit(name).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))
        return F.when(F.size(f"_e_{name}") > 0, F.zip_with(f"_m_{name}", f"_e_{name}", span).cast(SPAN)).otherwise(F.array().cast(SPAN))

    rows = rows.withColumns({n: placed(n) for n in found})
    return rows.drop(*(f"_{x}_{n}" for x in "mge" for n in found))


def running(values: Column, add) -> Column:
    """The running totals under `add` of an array of at least one int.

    By chunks and then over the chunks' totals: appending to an array copies it, so a step costs the length of a chunk and not that of the array.
    """
    last = lambda xs: F.element_at(xs, -1)
    totals = lambda xs: F.aggregate(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1), lambda a, x: F.concat(a, F.array(add(last(a), x))))
    # an array of one element hands what it holds to a lambda, so that it is worked out once
    held = lambda value, use: F.flatten(F.transform(F.array(value), use))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: totals(F.slice(xs, c * CHUNK + 1, CHUNK)))
    shifted = lambda chunk, c, ends: F.when(c == 0, chunk).otherwise(F.transform(chunk, lambda x: add(F.get(ends, c - 1), x)))
    joined = lambda chunks: held(totals(F.transform(chunks, last)), lambda ends: F.flatten(F.transform(chunks, lambda chunk, c: shifted(chunk, c, ends))))
    return held(values, lambda xs: held(cut(xs), joined))


def _kept(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]))


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the columns email, ip, card and phone, arrays of spans."""
    rows = matches(rows, text, {k: (F.col(text).rlike(GUARDS[k]), F.lit(PATTERNS[k])) for k in KINDS})
    return rows.withColumns({k: _kept(k) for k in KINDS})


def masked(text: Column) -> Column:
    """A-Z lower-cased, and e-mail addresses as blanks: what is left has its places as in the text."""
    gaps, found = F.split(text, PATTERNS["email"]), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), 0)
    blanks = F.concat(F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
    return lower_ascii(F.when(text.contains("@"), F.array_join(F.zip_with(gaps, blanks, lambda g, m: F.concat(g, m)), "")).otherwise(text))


def _words(low: Column) -> Column:
    """The distinct terms of a masked text."""
    return F.filter(F.array_distinct(F.split(low, r"[\x00-\x60\x7B-\x7F]+")), lambda w: F.length(w) >= MIN_LETTERS)


def _entity(span: Column) -> Column:
    """An entity whatever its punctuation and case."""
    return F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.concat(span["kind"], F.lit(":"), _digits(span["value"])))


def examined(docs: DataFrame, text: bool = False) -> DataFrame:
    """(doc_id, email, ip, card, phone, entities, key, low) for each of docs(doc_id, text), checkpointed; key and low, the masked text, are null without an entity."""
    rows = base_spans(docs).withColumn("entities", F.array_distinct(F.transform(F.concat(*KINDS), _entity)))
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\n"), F.col("text")).cast("binary"))
    rows = rows.withColumn("_held", F.size("entities") > 0)
    return checkpointed(rows.select("doc_id", *KINDS, "entities", F.when(F.col("_held"), key).alias("key"), F.when(F.col("_held"), masked(F.col("text"))).alias("low"), *["text"] * text))


def _telling(both: Column, with_term: Column, with_entity: Column, n: int, disclosure: float) -> Column:
    """Whether the PMI suffices; the more documents have both, the larger it is."""
    p = with_entity / F.lit(float(n))
    return (with_entity < n) & (F.log2((both + p) / ((with_term + 1) * p)) >= -F.log2(p) * disclosure)


def disclosing(docs: DataFrame, seen: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(key, terms): the terms that disclose an entity of the document. seen: as examined() gives it for docs."""
    n = max(2, seen.count())
    holders = checkpointed(seen.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("entities").alias("entities"), F.first("low").alias("low")))
    stands = holders.select("key", "rows", F.explode("entities").alias("entity"))
    hashed = F.xxhash64("key").cast("decimal(20,0)")
    entities = stands.groupBy("entity").agg(F.sum("rows").alias("with_entity"), F.count(F.lit(1)).alias("keys"), F.sum(hashed).alias("class"))
    classes = spread_join(stands.select("key", "entity"), checkpointed(entities), ["entity"], "keys").groupBy("key").agg(F.collect_set(F.struct("class", "with_entity")).alias("classes"))
    classes = checkpointed(classes)
    sizes = classes.select("key", F.array_distinct(F.transform("classes", lambda c: c["with_entity"])).alias("sizes"))
    # every word of the corpus is counted, in the tasks that read it before it is sent anywhere
    counts = docs.select(F.explode(_words(masked(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    own = holders.join(sizes, "key").select("key", "rows", "sizes", F.explode(_words(F.col("low"))).alias("term"))
    enough = lambda size: _telling(F.least(size, "with_term"), F.col("with_term"), size, n, disclosure)
    rare = spread_join(own, checkpointed(counts), ["term"], "with_term").where(F.exists("sizes", enough)).select("key", "rows", "term", "with_term")
    paired = rare.join(classes, "key").select("key", "rows", "term", "with_term", F.explode(F.filter("classes", lambda c: enough(c["with_entity"]))).alias("c"))
    paired = checkpointed(paired.select("key", "rows", "term", "with_term", "c.class", "c.with_entity"))
    joint = paired.groupBy("term", "class", "with_entity").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("keys"), F.first("with_term").alias("with_term"))
    told = joint.where(_telling(F.col("both"), F.col("with_term"), F.col("with_entity"), n, disclosure)).select("term", "class", "with_entity", "keys")
    return spread_join(paired.select("key", "term", "class", "with_entity"), checkpointed(told), ["term", "class", "with_entity"], "keys").groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def term_spans(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, term): the spans of disclosing terms, for documents with any."""
    rows = seen.where("key IS NOT NULL").select("key", "low").dropDuplicates(["key"]).join(disclosing(docs, seen), "key")
    letters = r"[a-z\x{80}-\x{10FFFF}]"
    # terms under their first two letters, so that a word is compared with few of them
    starts = F.array_distinct(F.transform("terms", lambda t: F.substring(t, 1, 2)))
    under = F.transform(starts, lambda s: F.concat(s, F.lit("(?:"), F.array_join(F.transform(F.filter("terms", lambda t: t.startswith(s)), lambda t: t.substr(F.lit(3), F.length(t))), "|"), F.lit(")")))
    rows = rows.withColumn("pattern", F.concat(F.lit(f"(?<!{letters})(?:"), F.array_join(under, "|"), F.lit(f")(?!{letters})")))
    return matches(rows, "low", {"term": (F.lit(True), F.col("pattern"))}).select("key", "term")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", text: bool = False) -> DataFrame:
    """A row for each of docs: (doc_id, email, ip, card, phone, term), arrays of spans, and the text if wanted."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    seen = examined(docs, text)
    rows = seen.select("doc_id", "key", *KINDS, *["text"] * text)
    none = F.array().cast(SPAN)
    held = rows.where("key IS NOT NULL").join(term_spans(docs, seen), "key", "left").withColumn("term", F.coalesce("term", none))
    columns = ["doc_id", *KINDS, "term", *["text"] * text]
    return held.select(*columns).unionByName(rows.where("key IS NULL").withColumn("term", none).select(*columns))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)."""
    rows = spans(docs, id_column, text_column)
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in (*KINDS, "term")]
    base = F.concat(*KINDS)
    return rows.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, "term")).alias("spans"))


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text): entities generalised to their kind in brackets, disclosing terms taken out."""
    rows = spans(docs, id_column, text_column, True)
    order = F.array_sort(F.transform(F.concat(*KINDS, "term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.select("doc_id", "text", order.alias("_s"))
    rows = rows.withColumn("_e", F.when(F.size("_s") > 0, running(F.transform("_s", lambda s: s["end"]), lambda a, x: F.greatest(a, x))))
    # a span begins where all before it have ended, or it is part of one
    mark = lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    cuts = F.zip_with("_s", F.concat(F.array(F.lit(0)), F.slice("_e", 1, F.size("_e") - 1)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), mark(s).alias("mark")))
    rows = rows.withColumn("_c", F.filter(cuts, lambda c: c["start"] >= c["at"]))
    # by chunks of cuts, as finding a place in a text takes time in proportion to the text
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_c") - 1) / CHUNK).cast("int")), lambda i: F.slice("_c", i * CHUNK + 1, CHUNK))

    def piece(chunk: Column) -> Column:
        begin, end = F.get(chunk, 0)["at"], F.element_at(chunk, -1)["start"]
        part = F.col("text").substr(begin + 1, end - begin)
        return F.array_join(F.flatten(F.transform(F.array(part), lambda p: F.transform(chunk, lambda c: F.concat(p.substr(c["at"] - begin + 1, c["start"] - c["at"]), c["mark"])))), "")

    rest = F.col("text").substr(F.element_at("_e", -1) + 1, F.length("text"))
    return rows.select("doc_id", F.when(F.size("_s") > 0, F.concat(F.array_join(F.transform(chunks, piece), ""), rest)).otherwise(F.col("text")).alias("text"))


def _sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the patterns as they were asked for
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    # a match begins after the gaps up to its own and the matches before it
    placed = "list_transform(range(1, len(m) + 1), lambda i: {{'v': m[i], 's': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint}})"
    found = lambda rows, text, pattern: f"(SELECT *, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {rows})"
    kinds = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest({placed.format()}) AS x FROM {found('d', 'text', p)}" for k, (kind, p) in enumerate(plain.items()))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({digits})[i + 1]::int ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][reverse({digits})[i + 1]::int + 1] END)) % 10 = 0"
    separators = r"[\x00-\x60\x7B-\x7F]+"
    terms = f"list_filter(list_distinct(string_split_regex(low, '{separators}')), lambda w: length(w) >= {MIN_LETTERS})"
    blanked = "array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || repeat(' ', coalesce(length(m[i]), 0)::bigint)), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, k, kind, x.v AS v, x.s AS s, x.s + length(x.v) AS e FROM ({kinds})),
base AS (
  SELECT * FROM raw WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS int), 0) > 255)) = 0
    WHEN 'card' THEN length({digits}) BETWEEN 13 AND 19 AND {luhn}
    ELSE length({digits}) BETWEEN 9 AND 15 END),
low AS (SELECT doc_id, {lower.format(blanked)} AS low FROM {found('d', 'text', plain['email'])}),
words AS (SELECT doc_id, unnest({terms}) AS term FROM low),
counts AS (SELECT term, count(*) AS with_term FROM words GROUP BY term),
stands AS (SELECT DISTINCT doc_id, CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE kind || ':' || {digits} END AS entity FROM base),
entities AS (SELECT entity, count(*) AS with_entity FROM stands GROUP BY entity),
joint AS (SELECT term, entity, count(*) AS both_ FROM stands JOIN words USING (doc_id) GROUP BY term, entity),
told AS (
  SELECT term, entity FROM joint JOIN counts USING (term) JOIN entities USING (entity), (SELECT greatest(count(*), 2)::double AS n FROM d)
  WHERE with_entity < n AND log2((both_ + with_entity / n) / ((with_term + 1) * (with_entity / n))) >= -log2(with_entity / n) * {DISCLOSURE}),
wanted AS (SELECT doc_id, list(DISTINCT term) AS terms FROM stands JOIN told USING (entity) JOIN words USING (doc_id, term) GROUP BY doc_id),
marked AS (SELECT doc_id, terms, low FROM low JOIN wanted USING (doc_id)),
spans AS (
  SELECT doc_id, k, kind, s, e FROM base
  UNION ALL SELECT doc_id, 4, 'term', x.s, x.s + length(x.v) FROM (SELECT doc_id, terms, unnest({placed.format()}) AS x FROM {found('marked', 'low', '[a-z' + chr(92) + 'x{80}-' + chr(92) + 'x{10FFFF}]+')}) WHERE list_contains(terms, x.v)),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 4) AS n_term,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS a FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint AS n_{k}" for k in (*KINDS, "term"))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN joined USING (doc_id)
"""


SQL = _sql()
