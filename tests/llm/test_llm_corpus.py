"""Operators that look at all documents, against plain versions; trained models on held-out rows; the pipeline."""

import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import messy
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.llm import languages, line_rules, models, quality, simhash
from quire.llm.common import documents, table
from quire.llm.graph import components


def roots_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(-5, 3), (500, 500)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots_of({n for p in pairs if p[0] != p[1] for n in p}, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_near(rows, index):
    """Doc -> smallest linked doc, by all pairs."""
    prints = [(d, tuple(map(int, simhash.fingerprint(t, index.shingle, index.words)))) for d, t in rows]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    return roots_of([d for d, _ in prints], [(a, b) for (a, x), (b, y) in combinations(prints, 2) if apart(x, y) <= index.distance])


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    want = plain_near(rows, simhash.Index())
    got = entry.queries()["op5_simhash"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{int(simhash.fingerprint(t, 3, 1)[0]):016x}" for d, t in rows}


@pytest.mark.parametrize("hot", [40, 10**6])
@pytest.mark.parametrize("index", [simhash.Index(), simhash.Index(width=32, radii=simhash.exact_radii(3, 2), distance=3, second_radius=3)])
def test_links_are_complete(spark, monkeypatch, hot, index):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(5)
    near = r.getrandbits(64)
    values = {near ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) ^ (r.random() < 0.4 and 1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(60)}
    nodes = list(enumerate(sorted(values)))
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in nodes], "node long, f0 long")
    got = [(x.a, x.b) for x in simhash.links(frame, index).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for (i, v), (j, w) in combinations(nodes, 2) if (v ^ w).bit_count() <= index.distance}


def test_simhash_messy(spark):
    got = simhash.near_duplicates(messy.docs(spark)).collect()
    by_doc = {r.doc_id: r for r in got}
    assert len(got) == len(messy.ROWS) and by_doc[1].component_id == by_doc[3].component_id == 1 and by_doc[1].f0 == 0
    assert by_doc[5].component_id == by_doc[6].component_id == 5 and by_doc[None].component_id is None
    kept = simhash.one_of_each(messy.docs(spark))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8] and kept.columns == messy.docs(spark).columns
    assert simhash.near_duplicates(messy.empty(spark)).count() == 0 and simhash.one_of_each(messy.empty(spark)).count() == 0


def test_near_copies(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    rows, groups = [], defaultdict(list)
    for g in range(40):
        words = [word() for _ in range(220)]
        for k in range(2):
            changed = list(words)
            for i in r.sample(range(220), 3 * k):
                changed[i] = word()
            groups[g].append(len(rows))
            rows.append((len(rows), " ".join(changed), "en", "s"))
    kept = {x.doc_id for x in simhash.one_of_each(messy.docs(spark, rows)).collect()}
    caught = sum(groups[g][1] not in kept for g in groups)
    assert all(groups[g][0] in kept for g in groups) and caught >= 38


def isolated_pairs(n, seed):
    """Pairs of texts of 300 five-word shingles each: Jaccard 0.802 (267 shared), and 0.7 for one pair in three."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows = []
    for g in range(n):
        words = [word() for _ in range(304)]
        changed = [word() if i % 5 == 2 and i < (35 if g % 3 else 57) else w for i, w in enumerate(words)]
        rows += [(2 * g, " ".join(words), "en", "s"), (2 * g + 1, " ".join(changed), "en", "s")]
    return rows


def test_isolated_near_copies(spark):
    """All pairs of Jaccard 0.8 or more are linked, though many are further apart than the distance of fingerprints."""
    rows = isolated_pairs(150, 3)
    want = plain_groups(rows)
    assert 60 < sum(want[d + 1] == d for d in range(0, 300, 2)) < 150
    assert {x.doc_id: x.component_id for x in simhash.near_copies(messy.docs(spark, rows)).collect()} == want


def plain_groups(rows, least=0.8):
    """Doc -> smallest doc that links of an exact Jaccard similarity reach, by all pairs that share a shingle."""
    sets, having = {}, defaultdict(list)
    for d, t, *_ in rows:
        w = (t or "").encode().translate(simhash.LOWER_BYTES).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    links = set()
    for d, x in sets.items():
        shared = Counter(e for g in x for e in having[g])
        links |= {(e, d) for e, n in shared.items() if n >= least * (len(x) + len(sets[e]) - n)}
        for g in x:
            having[g].append(d)
    return roots_of(sets, links)


def test_components_are_those_of_all_pairs(spark):
    """A large group of near copies, some of them far from most, pairs that are alike in few segments, and pairs of under 0.8."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(300)]
    rows = []
    for d in range(200):
        words = list(base)
        for i in r.sample(range(300), 1 if d % 5 else r.randrange(5, 14)):
            words[i] = word()
        rows.append((d, " ".join(words), "en", "s"))
    rows += [(1000 + d, *x) for d, *x in isolated_pairs(60, 6)]
    rows += [(2000 + d, " ".join(base[:150] + [word() for _ in range(40)]), "en", "s") for d in range(60)]  # a passage in common
    rows += [(3000 + d, "One two three FOUR five" + " six" * (d // 2), "en", "s") for d in range(40)]  # few and repeated shingles
    got = {x.doc_id: x.component_id for x in simhash.near_copies(messy.docs(spark, rows)).collect()}
    assert got == plain_groups(rows) and len(set(got.values())) > 100


def test_common_shingles_are_ranked_by_executors(spark, monkeypatch):
    """The driver gets the most common shingles as Arrow, without a row object for each and without the executors' own rankings."""
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: pytest.fail("rows collected to the driver"))
    monkeypatch.setattr(simhash, "MOST_COMMON", 5)
    texts = ["a b c d e f g h"] * 3 + ["b c d e f g h i j"] * 4 + ["a b c d e f g h i j k l"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("content", F.lit(0).cast("bigint"))
    n = Counter(k for t in texts for k in np.unique(simhash.shingles(t, 5)).view(np.int64).tolist())
    want = sorted(n, key=lambda k: (-n[k], k))[:5]
    assert simhash._common(docs, simhash.NEAR_COPIES).view(np.int64).tolist() == want
    assert len(simhash._common(docs.where("false"), simhash.NEAR_COPIES)) == 0


def test_recall_on_documents(spark):
    """All documents whose id is divisible by 20, against all rows."""
    docs = documents(spark, "/root/testdata/sf0.01")
    want = plain_groups([tuple(x) for x in docs.collect()])
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs).collect()}
    assert all(got[d] == want[d] for d in want if d % 20 == 0) and got == want


def test_one_of_each(spark):
    """Ties: rows of one id with unlike texts, and rows of one id and text."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1), "en", "a"), (1, text(2), "en", "a"), (1, text(2), "de", "a"), (1, text(2), "de", "a"), (2, text(1) + " end", "en", "a"), (None, text(3), "en", "a"), (9, text(3), "en", "a"), (None, text(4), None, None)]
    got = [simhash.one_of_each(messy.docs(spark, rows).repartition(n)).collect() for n in (1, 3)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert sorted((x.doc_id or 0, x.text) for x in got[0]) == [(0, text(4)), (1, text(1)), (1, text(2)), (9, text(3))]
    hot = [(d, text(5 + d % 2) + " end" * (d % 3), "en", "a") for d in range(3000)]
    assert sorted(x.doc_id for x in simhash.one_of_each(messy.docs(spark, hot)).collect()) == [0, 1]


# line frequency


def test_rules_query(spark, same_as_sql):
    assert same_as_sql(entry.queries()["op1_line_frequency"](spark, SF), line_rules.SQL) > 0


def test_boilerplate(spark):
    filler = lambda i: " ".join(f"word{chr(97 + i % 26)}{chr(97 + k)}" for k in range(15))
    rows = [(i, f"Menu, home - 12!\n{filler(i)}\nall rights reserved", "en", "s") for i in range(12)]
    rows += [(100 + i, f"menu HOME\n{filler(i)}", "en", "other") for i in range(3)]  # of another host
    rows += [(200 + i, "one text in many copies of the very same words as it happens\nand a line", "en", "s") for i in range(30)]
    rows += [(300 + i, f"a shared line that is all but the whole of this document number {'abcdefghijklmnop'[i]}\na shared line that makes up the most of some documents of this very host here", "en", "t") for i in range(12)]
    rows += [(400, "a shared line that makes up the most of some documents of this very host here\n\nmenu", "en", "t")]
    got = {r.doc_id: r for r in line_rules.judge(messy.docs(spark, rows)).collect()}
    assert got[0].n_lines_removed == 0 and got[0].kept  # the first keeps what it shares
    assert all(got[i].n_lines_removed == 2 and got[i].n_words_left == 15 and got[i].kept for i in range(1, 12))
    assert all(got[100 + i].n_lines_removed == 0 and got[100 + i].kept for i in range(3))
    assert all(got[200 + i].n_lines_removed == 0 and got[200 + i].kept for i in range(30))
    assert got[400].n_lines_removed == 1 and not got[400].kept and not got[400].base_failed
    clean = {r.doc_id: r for r in line_rules.clean(messy.docs(spark, rows)).collect()}
    assert clean[3].text == filler(3) and clean[3].n_chars == len(filler(3)) and 400 not in clean and clean[0].text == rows[0][1]
    assert clean[3].n_words == 7 and clean[3].removed == 7  # a column of that name is left alone


def plain_measures(text):
    words = text.replace("\n", " ").split() if text.isascii() else [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice(["a ", "b ", "c\n", "d\t", "#", "é ", " \n"]) for _ in range(r.randrange(60))), "en", "s") for i in range(200)]
    got = {x.doc_id: x for x in line_rules.judge(messy.docs(spark, rows)).collect()}
    for d, t, *_ in rows:
        x = got[d]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain_measures(t)
    messy_ = line_rules.judge(messy.docs(spark)).collect()
    assert len(messy_) == len(messy.ROWS) and not next(x for x in messy_ if x.doc_id == 1).kept
    assert line_rules.judge(messy.empty(spark)).count() == 0 and line_rules.clean(messy.empty(spark)).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    filler = lambda i: " ".join(f"word{chr(97 + i % 26)}{chr(97 + k)}" for k in range(15))
    rows = [(i, f"menu home\n{filler(i)}", "en", "s") for i in range(12)]
    names = "_w _m _id _x _h _l _c _content of host id content place line removed kept".split()
    docs = messy.docs(spark, rows).select("doc_id", "text", "source", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    out = line_rules.clean(docs)
    assert out.columns == docs.columns and out.count() == 12
    assert all([r[n] for n in names] == list(range(len(names))) and r.text == (rows[0][1] if r.doc_id == 0 else filler(r.doc_id)) for r in out.collect())


def test_a_line_in_half_of_all_rows(spark):
    filler = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k)}" for k in range(15))
    rows = [(i, ("shared line\n" if i % 2 else "") + filler(i), "en", "s") for i in range(3000)]
    got = line_rules.judge(messy.docs(spark, rows)).collect()
    assert all(r.n_lines_removed == (r.doc_id % 2 and r.doc_id != 1) and r.kept for r in got)


# trained models


def test_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = entry.queries()["op6_languages"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_languages_messy(spark):
    network = languages.train(messy.docs(spark))
    got = {r.doc_id: r for r in languages.identify(messy.docs(spark), network).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred in network.languages
    assert languages.identify(messy.empty(spark), network).count() == 0
    none = languages.train(messy.empty(spark))
    assert {r.lang_pred for r in languages.identify(messy.docs(spark), none).collect()} == {"und"}


def plain_language(text, network):
    """The forward pass of one text, place by place, window by window."""
    if not text or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    p, data, total, weight = network.weights, text.encode(), 0.0, 0
    for s in range(0, len(data), languages.WINDOW):
        window = data[s : s + languages.WINDOW + languages.TAPS - 1].ljust(languages.WINDOW + languages.TAPS - 1, b"\0")
        if len(data) - s < languages.WINDOW:
            window = data[s:].ljust(languages.WINDOW + languages.TAPS - 1, b"\0")
        e = [p["embedding"][c] for c in window]
        conv = np.array([sum(e[i + t] @ p["filters"][t] for t in range(languages.TAPS)) for i in range(languages.WINDOW)])
        z = np.maximum(conv.max(0) + p["bias"], 0) @ p["output"] + p["output_bias"]
        used = sum(c != 0 for c in data[s : s + languages.WINDOW])
        total, weight = total + used * np.exp(z - z.max()) / np.exp(z - z.max()).sum(), weight + used
    mean = total / weight
    return network.languages[int(mean.argmax())], float(mean.max())


def test_languages_forward(spark):
    docs = documents(spark, SF, "doc_id", "text", "lang")
    network = languages.train(docs)
    got = {r.doc_id: r for r in languages.identify(docs, network).collect()}
    for d, text, _ in docs.limit(25).collect():
        lang, score = plain_language(text, network)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-4)


def test_letters(spark):
    rows = [(1, "½ ² Ⅷ 12 _!", "en", "s"), (2, "\u4e2d", "en", "s"), (3, "12 ª", "en", "s"), (4, "\u0301 ①", "en", "s")]
    got = {r.doc_id: r.lang_pred for r in languages.identify(messy.docs(spark, rows), languages.train(documents(spark, SF, "doc_id", "text", "lang"))).collect()}
    assert got[1] == got[4] == "und" and "und" not in (got[2], got[3])


def test_long_training_texts_are_bounded(spark):
    docs = messy.docs(spark, [(i, "abcdefghij" * 30_000 + str(i), "en", "s") for i in range(3)] + [(9, "short", "en", "s"), (10, None, "en", "s")])
    got = docs.select("doc_id", models.training_text("doc_id", "text").alias("t"), "text").collect()
    assert all(r.t == r.text if r.doc_id > 8 else len(r.t) == models.TRAINING_CHARACTERS and r.t in r.text for r in got)
    rows = spark.range(9000).selectExpr("id % 3 AS doc_id", "id AS x")
    assert models.bounded_sample(rows, 1000).count() <= 2000
    a, b = (sorted(map(tuple, models.bounded_sample(rows.repartition(n), 1000).collect())) for n in (2, 5))
    assert a == b


def plain_quality(text, model):
    """The score of one text, passage by passage."""
    x, _ = quality.passages([text])
    p, hs, es = model.weights, [], []
    for row in (x - model.mean) * model.scale:
        h = np.tanh(row @ p["encoder"] + p["encoder_bias"])
        hs.append(h)
        es.append(float((np.tanh(h @ p["v"]) * (1 / (1 + np.exp(-(h @ p["u"]))))) @ p["w"][:, 0]))
    a = np.exp(np.array(es) - max(es))
    z = sum(w * h for w, h in zip(a / a.sum(), hs))
    return 1 / (1 + np.exp(-(z @ p["output"][:, 0] + p["bias"][0])))


def plain_features(text):
    """The features of a text's passages, byte by byte and word by word."""
    data, seen, out = text.encode() or b"\0", set(), []
    words = [(m.start(), m[0]) for m in __import__("re").finditer(rb"[^ \t\n\r\x0b\x0c\x00]+", data)]
    for s in range(0, len(data), quality.PASSAGE):
        part, row = data[s : s + quality.PASSAGE], np.zeros(quality.N_FEATURES)
        for a, b in zip(part, part[1:]):
            row[quality.CLASS[a] * quality.N_CLASSES + int(quality.CLASS[b])] += 1 / len(part)
        own, again = [w for at, w in words if s <= at < s + quality.PASSAGE], 0
        for w in own:
            h = sum((c + 1) * int(quality.POWERS[min(i, 63)]) for i, c in enumerate(w)) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
            row[quality.N_PAIRS + (h >> 48) % quality.N_WORDS] += 1
            again += w in seen
            seen.add(w)
        row[quality.N_PAIRS : -2] = np.log1p(row[quality.N_PAIRS : -2])
        row[-2], row[-1] = np.log1p(len(part)) / 8, again / max(1, len(own))
        out.append(row)
    return np.array(out)


def test_quality_forward(spark):
    docs = documents(spark, SF)
    model = quality.train(docs, table(spark, SF, "labels"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for d, text in docs.limit(40).collect():
        assert np.allclose(quality.passages([text])[0], plain_features(text or ""), atol=1e-5)
        assert got[d].score == pytest.approx(plain_quality(text, model), abs=1e-4)


def test_network_tables_equal_its_layers():
    network = languages.ByteNetwork(["a", "b"])
    x = np.frombuffer(b"some bytes to look at, quite a few of them", np.uint8)
    first, last = network.tables()
    pairs = x[:-1].astype(int) * 256 + x[1:]
    e = network.weights["embedding"][x]
    plain = sum(e[t : len(x) - 3 + t] @ network.weights["filters"][t] for t in range(4))
    assert np.allclose(first[pairs[:-2]] + last[pairs[2:]], plain, atol=1e-4)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op10_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in got)


def test_quality_messy(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, None), (99, 1), (4, 0)], "doc_id long, quality int")
    model = quality.train(messy.docs(spark), labels)
    got = quality.score(messy.docs(spark), model).collect()
    assert len(got) == len(messy.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(messy.empty(spark), model).count() == 0
    blank = quality.train(messy.docs(spark), labels.where("false"))
    assert {r.score for r in quality.score(messy.docs(spark), blank).collect()} == {0.5}
    assert quality.accept(messy.docs(spark), blank).count() == len(messy.ROWS)


def test_attention_gradients():
    """The learnt direction is that of the loss."""
    r = np.random.default_rng(0)
    model = quality.AttentionModel()
    x, starts = r.normal(size=(9, quality.N_FEATURES)).astype(np.float32), np.array([0, 2, 3, 7])
    y = np.array([1, 0, 1, 0], np.float32)
    before = [model._forward((x - x.mean(0)) / (x.std(0) + 0.01), starts)[-1]]
    model.fit(x, starts, y, rounds=60, decay=0)
    after = model._forward((x - model.mean) * model.scale, starts)[-1]
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(after) < 0.1 < loss(before[0])


# the pipeline


def test_pipeline(spark):
    """Each stage against a plain version over what its predecessor kept."""
    import corpus_pipeline as pipeline
    import public_tokenizers as P
    from test_llm_text import check_packed
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    plain = docs.collect()
    model = quality.train(docs, table(spark, SF, "labels"))
    plain = [r for r in plain if model.score([r.text])[0] >= quality.THRESHOLD]
    # rules: lines of more than ten distinct texts of a source stay in the first document alone
    found = defaultdict(lambda: [set(), []])
    normal = lambda x: " ".join(__import__("re").split("[\x00-\x60\x7b-\x7f]+", x.lower())).strip()
    for r in plain:
        for x in r.text.split("\n"):
            if normal(x):
                found[r.source, normal(x)][0].add(r.text)
                found[r.source, normal(x)][1].append(r.doc_id)
    kept = []
    for r in plain:
        n, _, _, _, repeated = plain_measures(r.text)
        lines = r.text.split("\n")
        gone = {i for i, x in enumerate(lines) if normal(x) and len(found[r.source, normal(x)][0]) > 10 and min(found[r.source, normal(x)][1]) != r.doc_id}
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        left = len(text.split())
        if n >= 10 and 100 * repeated <= 20 * n and not (gone and (left < 10 or left < 0.3 * n)):
            kept.append((r.doc_id, text))
    roots = plain_groups(kept)
    kept = [(d, t) for d, t in kept if roots[d] == d]
    from quire.llm.secrets import redact_text

    want = {d: redact_text(t) for d, t in kept}
    got = pipeline.run(spark, SF).collect()
    check_packed(got, want, Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "secret scans", "packing"]
    stage = dict(pipeline.STAGES)["secret scans"](spark, docs, SF)
    assert stage.columns == docs.columns and stage.count() == docs.count()
