"""Operators 1, 3, 5, 6, 7 and 9 against brute force, held-out accuracy and odd tables; the pipeline stage by stage."""

import hashlib
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import common, components, decontaminate, fmindex, jaccard, language, pages, quality, secrets
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(doc_id, text) with the other columns of documents and some clashing ones."""
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS).selectExpr("*", "1 AS key", "2 AS score", "3 AS cid", "4 AS n", "'y' AS phrase")


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (5, "other"), (None, "one"), (7, "long " * 50_000), (8, "é ñ ü " * 9)]


# ---- decontamination ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sigma, longest", [(1, 40), (3, 60), (50, 200)])
def test_fm_index_against_search(sigma, longest):
    rng = np.random.default_rng(sigma)
    for _ in range(60):
        s = np.append(rng.integers(0, sigma + 1, rng.integers(1, longest)), 0).astype(np.int64)
        index = fmindex.FmIndex(s, sigma)
        width = int(rng.integers(1, 6))
        phrases = rng.integers(1, sigma + 1, (8, width))
        which, lo, hi = index.search(phrases)
        got = {tuple(phrases[k]): sorted(index.locate(np.arange(a, b))) for k, a, b in zip(which, lo, hi, strict=True)}
        for p in phrases:
            want = [i for i in range(len(s) - width + 1) if (s[i : i + width] == p).all()]
            assert got.get(tuple(p), []) == want


def leaks(spark, texts, items, window=10):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS phrase", "2 AS items")
    return {r["doc_id"]: r for r in decontaminate.mark_leaks(docs(spark, texts), bench, window=window).collect()}


def test_leaks_of_odd_rows(spark):
    items = [(1, "One"), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (None, "one"), (3, None), (4, "?!")]
    texts = [(1, None), (2, ""), (3, "ONE, two"), (4, "x A B C D E F G H I J y"), (5, "b c d e f g h i j"), (6, "a b c d e f g h i j k " * 3)]
    got = leaks(spark, texts, items)
    assert {k: (r["leak_words"], [tuple(s) for s in r["leak_spans"]], r["leak_items"]) for k, r in got.items()} == {
        1: (0, [], []), 2: (0, [], []), 3: (2, [(0, 1)], ["1"]), 4: (12, [(1, 11)], ["2"]), 5: (9, [], []),
        6: (33, [(0, 33)], ["2"]),
    }
    assert leaks(spark, texts, [])[6]["leak_spans"] == []


def test_leaks_across_blocks_and_shards(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30)]
    texts = [(k, "start " + items[k][1] + " mid " + items[(k + 1) % 30][1]) for k in range(30)]
    want = {k: (r["leak_spans"], r["leak_items"]) for k, r in leaks(spark, texts, items).items()}
    monkeypatch.setattr(decontaminate, "PHRASES", 7)
    got = {k: (r["leak_spans"], r["leak_items"]) for k, r in leaks(spark, texts, items).items()}
    assert got == want and all(len(v[1]) == 2 and len(v[0]) == 2 for v in got.values())
    monkeypatch.setattr(decontaminate, "MOST", 64)
    shard = decontaminate.Shard([" ".join(f"w{j}" for j in range(309)).encode()], 10)
    shard.search([[f"w{j}".encode() for j in range(i, i + 10)] for i in range(300)], [[str(i)] for i in range(300)])
    assert len(shard.pieces) > 4 and shard.spans() == [[(0, 309)]] and shard.items[0] == set(map(str, range(300)))


def test_index_holds_every_word():
    """Also words that no phrase has: any phrase of the shard can be counted and found."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)).encode() for n in (0, 1, 40, 300, 2000)]
    shard = decontaminate.Shard(texts, 10)
    for size in (1, 2, 3):
        for _ in range(50):
            phrase = [f"w{x}".encode() for x in rng.integers(0, 31, size)]
            shard.items, shard.marks = [set() for _ in texts], np.zeros_like(shard.marks)
            shard.search([phrase], [["i"]])
            for text, spans, items in zip(texts, shard.spans(), shard.items, strict=True):
                w = text.split()
                hit = {i + j for i in range(len(w) - size + 1) if w[i : i + size] == phrase for j in range(size)}
                assert {k for a, b in spans for k in range(a, b)} == hit and bool(items) == bool(hit)


def test_leaks_with_clashing_columns_and_string_ids(spark):
    bench = spark.createDataFrame([("item-10", "leak of three"), ("item-9", "leak of three")], "item_id string, text string")
    df = docs(spark, [(1, "a leak of three"), (2, "clean")]).selectExpr("*", "7 AS leak_words", "8 AS Leak_Spans")
    for action, left in (("drop", {2: "clean"}), ("excise", {1: "a ", 2: "clean"})):
        out = decontaminate.decontaminate(df, bench, action=action)
        assert out.columns == df.columns and {(r["leak_words"], r["Leak_Spans"]) for r in out.collect()} == {(7, 8)}
        assert {r["doc_id"]: r["text"] for r in out.collect()} == left
    assert [r["leak_items"] for r in decontaminate.mark_leaks(df, bench).filter("doc_id = 1").collect()] == [["item-10", "item-9"]]


def test_excised_and_dropped(spark):
    bench = spark.createDataFrame([(1, "leak of three")], "item_id long, text string")
    df = docs(spark, [(1, "Before, Leak of THREE! after"), (2, "clean"), (3, None)])
    out = decontaminate.decontaminate(df, bench, action="excise")
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Before, ! after", 2: "clean", 3: None}
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {2, 3}


# ---- near duplicates ------------------------------------------------------------------------------------------------


def brute_components(texts, width, num, den):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(texts):
        smallest[find(k)] = min(smallest.get(find(k), 1 << 60), i)
    return [(texts[k][0], len(sets[k]), smallest[find(k)]) for k in range(len(texts))]


def variants(rng, n, edits, size=120):
    base = [f"b{j}" for j in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(size, rng.integers(0, edits + 1), replace=False):
            w[at] = f"e{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width, num, edits, small", [(3, 90, 3, 32), (5, 80, 4, 4), (3, 90, 5, 2)])
def test_near_duplicates_brute_force(spark, monkeypatch, width, num, edits, small):
    """Also with buckets that are always large, so that stars, likeliest pairs and blocks are all walked."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(edits)
    made = [*variants(rng, 60, edits), *variants(rng, 30, edits, 40), *(" ".join(f"r{x}" for x in rng.integers(0, 40, 60)) for _ in range(60))]
    texts = [(int(i), t) for i, t in zip(rng.permutation(len(made)), made, strict=True)]
    texts += [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "  \n")]
    got = jaccard.near_duplicates(docs(spark, texts), width=width, num=num, den=100).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(texts, width, num, 100))


@pytest.mark.parametrize("small, block", [(32, 384), (2, 16)])
def test_number_of_links(spark, monkeypatch, small, block):
    """All links between different sets, also inside a group of near copies that is connected by few of them."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(3)
    texts = list(enumerate([*variants(rng, 90, 3), *variants(rng, 20, 3, 50), "a b", "A b", ""]))
    got = jaccard.near_duplicates(docs(spark, texts), width=3, num=80, den=100, links=True).collect()
    sets = {i: frozenset(zip(*[t.lower().split()[k:] for k in range(3)], strict=False)) or frozenset([t.lower()] * bool(t)) for i, t in texts}
    distinct = set(sets.values())
    count = {s: sum(s != o and bool(s & o) and 100 * len(s & o) >= 80 * len(s | o) for o in distinct) for s in distinct}
    assert sum(count.values()) > 2 * len(texts)
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: count[s] for i, s in sets.items()}
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute_components(texts, 3, 80, 100))


def test_rows_dealt_for_near_copies_that_do_not_link(spark, monkeypatch):
    """Rows of a hot bucket go only to blocks that they may link with: some rows a posting, not one for every block."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    whole, dealt = jaccard._open_rows, []

    def counted(large, *more):
        out = whole(large, *more)
        dealt.append((large.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_open_rows", counted)
    texts = list(enumerate(variants(np.random.default_rng(5), 480, 6)))
    got = jaccard.near_duplicates(docs(spark, texts), width=5, num=80, den=100).collect()
    want = brute_components(texts, 5, 80, 100)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert 100 < len({r[2] for r in want}) < 400  # many stay apart
    assert len(dealt) == 2 and sum(n for _, n in dealt) < 4 * dealt[0][0]


def test_near_duplicates_of_odd_rows(spark):
    got = [tuple(r) for r in jaccard.near_duplicates(docs(spark, ODD)).collect()]
    assert len(got) == len(ODD)
    assert (4, 1, 4) in got and (None, 1, 4) in got and (5, 1, 5) in got and (1, 0, 1) in got
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicates(docs(spark, [(None, "x y")] * 2)).collect()] == [(None, 1, None)] * 2


def test_word_hashes_do_not_depend_on_place():
    a, b = (common.shingles(t, 1) for t in (b"alpha BETA gamma", b"x " * 70_000 + b"beta gamma alpha"))
    assert set(a.tolist()) < set(b.tolist()) and len(b) == 4
    assert common.shingles(b"a b", 3).size == 1 and common.shingles(b"", 3).size == 0 == common.shingles(None, 3).size


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 5), (6, 7), (5, 6), (9, 9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(20)).collect()}
    assert got == {**{k: 100 for k in range(101, 141)}, 6: 5, 7: 5}


# ---- secrets --------------------------------------------------------------------------------------------------------


def test_secrets_on_odd_rows(spark):
    texts = [
        (1, None), (2, ""), (3, 'é API_KEY = "abcdef" secret: abc token:token=abcdefg'), (4, "AKIA" + "Z9" * 8 + " AKIASHORT"),
        (5, "x deadbeefdeadbeefdeadbeef y"), (6, "key Zx9Qm2Lr8Tv4Wp1Yb6Nc3Kd7 end"), (7, "d41d8cd98f00b204e9800998ecf8427e and 123e4567-e89b-12d3-a456-426614174000"),
        (8, "internationalization-of-things v2 docs/readme-2024-01-01 2024/01/01-12_30 user_name_field_2"),
    ]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in secrets.find_secrets(docs(spark, texts)).collect()}
    assert got[1] == got[2] == got[8] == []
    assert got[3] == [("assign", 2, 19), ("assign", 33, 52)]
    assert got[4] == [("access", 0, 20)] and got[5] == [("hex", 2, 26)]
    assert got[6] == [("random", 4, 28)] and [k for k, *_ in got[7]] == ["hex"]


def test_random_spans_against_plain_rules(spark):
    """Brute force over a table: every run of key characters, the ratio, the exclusions."""
    with open(secrets.VOCABULARY, "rb") as file:
        encoder = secrets.encoding(file.read())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts |= {9000: "é " + "Zx9Qm2Lr8Tv4Wp1Yb6Nc3Kd7 " * 30, 9001: "token=abcdefg" + "hQzXvBnWkLpJ" * 3, 9002: "qxzvkjwpfhgbtmcd qxzvkjwpfhgbtmcd12 " * 2}
    found = secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    added = 0
    for r in found:
        t = texts[r["doc_id"]]
        base = [s for s in r["found"] if s["kind"] != "random"]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", t):
            if any(s["start"] < m.end() and m.start() < s["end"] for s in base):
                continue
            body = m[0].rstrip("=")
            digest = re.fullmatch(r"[0-9a-fA-F]+", body) and len(body) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", body)
            tight = len(m[0]) <= 2.0 * len(encoder.encode_ordinary(m[0]))
            name = re.fullmatch(r"[A-Za-z]*([/_-][A-Za-z]+)*([/_-]?v?[0-9]{1,4}){0,4}|[0-9/_+-]+", body)
            if re.search("[A-Za-z]", body) and not digest and tight and not (name and secrets.of_words(body.encode(), encoder)):
                want.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "random"] == want
        added += len(want)
    assert added > 30


def test_secrets_in_long_texts_and_empty_tables(spark):
    text = 'api_key = "abcdefgh" Zx9Qm2Lr8Tv4Wp1Yb6Nc3Kd7 ' * 20_000
    began = time.perf_counter()
    got = secrets.find_secrets(docs(spark, [(1, text), (1, text)]).withColumn("found", F.lit(1))).collect()
    assert [len(r["found"]) for r in got] == [40_000] * 2 and time.perf_counter() - began < 90
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_secrets_against_plain_patterns(spark):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in secrets.op9_secret_scan(spark, SF).collect():
        t = texts[r["doc_id"]]
        s = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# ---- trained --------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in language.op5_language_id(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 100
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_marks_switches():
    tagger = language.Tagger(["x", "y"], {})
    left, right = ([f"{p}{k % 9}a".encode().replace(b"0", b"o") for k in range(40)] for p in ("lam", "rof"))
    left, right = ([re.sub(rb"\d", b"i", w) + bytes([97 + k % 20]) for k, w in enumerate(s)] for s in (left, right))
    tagger.fit([left, right, left[:20] + right[20:]], [np.zeros(40, int), np.ones(40, int), np.repeat([0, 1], 20)])
    assert tagger.label([b" ".join(left), b" ".join(right)])[0] == ["x", "y"]
    assert tagger.label([b"", None, b"123 !", "—…".encode()]) == (["und"] * 4, [0.0] * 4)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    ids, sizes = np.array([0, 1, 2, 3, 4, 1, 0]), np.array([4, 3])
    post, pairs = language.forward_backward(ids, sizes, emit, trans, pairs=True)
    want, moves, at = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for n in sizes:
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        weight = np.array([sum(emit[ids[at + k], p[k]] for k in range(n)) + sum(trans[p[k], p[k + 1]] for k in range(n - 1)) for p in paths])
        weight = np.exp(weight - weight.max())
        weight /= weight.sum()
        for p, w in zip(paths, weight, strict=True):
            for k in range(n):
                want[at + k, p[k]] += w
                if k:
                    moves[p[k - 1], p[k]] += w
        at += n
    assert np.allclose(post, want) and np.allclose(pairs, moves)


def test_language_of_odd_rows(spark):
    """Repeated rows, very long texts, clashing columns, an empty table, signs that are no letters."""
    rows = [(k, ("alpha beta gamma " if k % 2 else "uno dos tres ") * 5) for k in range(60)]
    df = spark.createDataFrame([(i, t, "xy"[i % 2], "s", 9) for i, t in rows], DOCS).selectExpr("*", "'z' AS lang_pred", "2 AS score", "3 AS words", "4 AS id")
    tagger = language.train(df)
    odd = spark.createDataFrame([(1, "alpha beta " * 200_000, "x", "s", 9), (1, "dos uno", "x", "s", 9), (1, "dos uno", "x", "s", 9), (2, "½ ²³ ①", "x", "s", 9), (None, "uno", None, None, None)], DOCS)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify(odd.selectExpr("*", "'z' AS lang_pred"), tagger).collect())
    assert got == [(0, "x"), (1, "x"), (1, "x"), (1, "y"), (2, "und")]
    assert language.identify(df.limit(0), tagger).count() == 0 and language.train(df.limit(0)).langs == []


def test_language_without_labels(spark):
    df = docs(spark, [(1, "a text"), (2, None)]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(df, language.train(df)).collect()] == [("und", 0.0)] * 2


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op6_quality_classifier(spark, sf).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (7, None), (None, 0)], "doc_id long, quality int")
    df = docs(spark, ODD)
    scored = quality.score_quality(df, quality.train(df, labels))
    assert scored.columns == [*df.columns, "quality_score"] and scored.count() == len(ODD)
    none = quality.train(df, labels.limit(0))
    assert {r["quality_score"] for r in quality.score_quality(df, none).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), none).count() == 0


def test_quality_keeps_clashing_columns(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    df = docs(spark, ODD).selectExpr("*", "'mine' AS quality_score", "1 AS _id")
    kept = quality.keep_quality(df, quality.train(df, labels), 0.0)
    assert kept.columns == df.columns and kept.count() == len(ODD) and {r["quality_score"] for r in kept.collect()} == {"mine"}
    assert quality.keep_quality(df, quality.train(df, labels), 2.0).count() == 0


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Model(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


# ---- random keys and many languages ----------------------------------------------------------------------------------


def test_every_language_is_learned(spark):
    """More labels than 64, the last ones with a few documents only."""
    made = [(k, f"w{chr(97 + k % 70 // 26)}{chr(97 + k % 26)}" + "x", f"l{k % 70:02}") for k in range(700)]
    rows = [(k, " ".join([w] * 12), lang, "s", 9) for k, w, lang in made]
    rows += [(1000 + k, "rare words here", "zz", "s", 9) for k in range(6)]
    tagger = language.train(spark.createDataFrame(rows, DOCS), most_rows=140)
    assert tagger.langs == [*(f"l{k:02}" for k in range(70)), "zz"]


@pytest.mark.parametrize("letters, size", [("ab", 16), ("aA", 16), ("aA", 24), ("aA0", 16), ("aA0+", 16), ("aA0", 20)])
def test_random_keys_are_found(letters, size):
    with open(secrets.VOCABULARY, "rb") as file:
        encoder = secrets.encoding(file.read())
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    signs = low + (up if "A" in letters else "") + ("0123456789" if "0" in letters else "") + ("+/" if "+" in letters else "")
    rng = np.random.default_rng(size)
    keys = ["".join(rng.choice(list(signs), size)).encode() for _ in range(1000)]
    assert sum(secrets.is_random(k, encoder, secrets.MOST_RATIO) for k in keys) >= 980
    for name in (b"build-2024-01-02-v1", b"internationalization", b"getElementsByClassName", b"release/v10/2/33/4", b"2024-01-02-10-20", b"some_dashed-words_here"):
        assert not secrets.is_random(name, encoder, secrets.MOST_RATIO), name


# ---- pages ----------------------------------------------------------------------------------------------------------

ROOM = """<html><head><title>t</title><style>p{}</style></head><body><header class=top><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="layout"><aside class="sidebar"><p>Side text that is rather long, longer than others</p></aside>
<%s><h2>Title %d &eacute; &lt;b&gt;</h2><p>First   line\n of %d<p>Second <a href=#>link</a> &amp more<br>after break<ul><li>one<li>two</ul>%s
<form><input> search</form><script>var a = "<p>no</p>";</script><div class="ad">Buy</div><div class="comments"><p>Great post</p></div></%s></div>
<!-- <p>hidden</p> --><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"', "div class=page7"])
def test_main_text_by_wrapper(tag):
    end = tag.split()[0]
    made = [ROOM % (tag, k, k, "<p>More.</p>" * k, end) for k in range(4)]
    path = pages.best_path(pages.infer(made))
    for k, html in enumerate(made):
        want = "\n".join([f"Title {k} é <b>", f"First line of {k}", "Second link & more", "after break", "one", "two", *["More."] * k])
        assert pages.extract(html, path) == want and pages.extract(html, []) == want


INNER = """<p>Lead {0} of the piece.</p><section id="discussion"><h2>Discussion</h2><p>We discuss {0}.</p><p>And more {0}.</p></section>
<div class="related-work"><p>Earlier work {0} did this.</p></div><div class="alert box"><p>Mind the gap {0}.</p></div>
<p>Energy <math><mi>E</mi><mo>=</mo><mi>m{0}</mi></math></p><p hidden>Folded {0}</p><div id="notice-1"><p>All rights reserved.</p></div>
<div class="related"><a href=/a>Teaser one {0}</a> <a href=/b>Teaser two {0}</a></div>
<div id="responses"><div class=c><b>Ann</b><p>First! {0}</p></div><div class=c><b>Bob</b><p>Agreed {0}</p></div></div>"""


@pytest.mark.parametrize("tag", ["article", "main", "div class=k3", "div"])
def test_doubtful_names_are_decided_by_the_wrapper(spark, tag):
    page = "<body><nav><a href=/>Home</a></nav><{1}><h1>Title {0}</h1>" + INNER + "</{2}><footer>end</footer>"
    rows = [(k, "http://h/", page.format(k, tag, tag.split()[0])) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(6):
        assert got[k].split("\n") == [
            f"Title {k}", f"Lead {k} of the piece.", "Discussion", f"We discuss {k}.", f"And more {k}.", f"Earlier work {k} did this.",
            f"Mind the gap {k}.", f"Energy E=m{k}", f"Folded {k}",
        ]


@pytest.mark.parametrize("limit", [1 << 16, 0])
def test_alignment_against_brute_force(monkeypatch, limit):
    """Partners rise in both lists and match; within the table's size there are as many as a plain search finds."""
    monkeypatch.setattr(pages, "CELLS", limit)
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (["".join(x) for x in rng.choice(list("pqr"), (rng.integers(0, 9), 1))] for _ in "ab")
        found = pages._partners(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < y and v < w for (x, v), (y, w) in zip(found, found[1:], strict=False))
        longest = {(): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                tries = [longest.get((i - 1, j), 0), longest.get((i, j - 1), 0)]
                longest[i, j] = max(*tries, longest.get((i - 1, j - 1), 0) + 1 if i and j and a[i - 1] == b[j - 1] else 0)
        assert limit == 0 or len(found) == longest[len(a), len(b)]


def test_very_many_siblings():
    made = ["<body><div class=top>menu</div><div class=x>" + "".join(f"<p>a{k} {j}</p><{'i' if (j * (k + 1)) % 3 else 'u'}>n</i></u>" for j in range(50_000)) + "</div>" for k in range(2)]
    began = time.perf_counter()
    path = pages.best_path(pages.infer(made))
    for k, html in enumerate(made):
        text = pages.extract(html, path)
        assert text.count(f"a{k} ") == 50_000
    assert time.perf_counter() - began < 120


def test_forty_five_levels_without_names(spark):
    page = "<body><div>Tagline</div>" + "<div>" * 45 + "<h2>Deep {0}</h2><p>Text of the deep page {0}</p>" + "</div>" * 45 + "<div><p>Short {0}</p></div>"
    rows = [(k, "http://h/", page.format(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Deep {k}\nText of the deep page {k}" for k in range(4)}


def test_wrapper_generalises():
    a, b = "<ul><li>x<li>y</ul><p>same</p><p>one</p>", "<ul><li>z</ul><p>same</p><p>two</p><h2>extra</h2>"
    w = pages.infer([a, b])
    keys = {(k.key, k.rep, k.opt) for k in w.kids}
    assert ("h2|", False, True) in keys and any(k.rep for k in w.kids if k.tag == "p")
    assert w.kids[0].kids[0].rep  # list items are a repeated group


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("just text", "just text"), ("<p>a", "a"), ("<nav>x</nav>", ""), ("<article>a < b</article>", "a < b"), ("<article><p>cut <b", "cut"), ("<script>x", "")])
def test_broken_pages(html, text):
    assert pages.extract(html, ["html|", "body|"]) == text


def test_deep_pages():
    assert pages.extract("<div>" * 30_000 + "deep", []) == "deep"
    assert pages.extract("<article>" + "<i>" * 5000 + "x", []) == "x"


@pytest.mark.parametrize("tag", ["div", "font", "span"])
def test_depth_hides_no_text(tag):
    for deep in (10, 39, 41, 60, 3000):
        made = [f"<body><div class=top1><p>tagline</p></div>{f'<{tag}>' * deep}<p>Long article {k} text</p><p>and its end {k}</p>" for k in range(3)]
        path = pages.best_path(pages.infer(made))
        for k, html in enumerate(made):
            want = f"Long article {k} text\nand its end {k}"
            assert pages.extract(html, []) == want and pages.extract(html, path) == want


def test_pages_against_the_article(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in pages.op3_html_extraction(spark, SF).collect():
        body = re.search("<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_rare_template_of_a_large_host(spark):
    """Its pages also hold the content path of the host's common template, as a teaser or empty."""
    common_ = "<body><div class=box><h1>Post {0}</h1><p>Body text of the post {0}</p></div><div class=foot1><p>the same everywhere</p></div>"
    rare = "<body><div class=box>{1}</div><div class=page><h2>Guide {0}</h2><p>A long guide that only few pages have {0}</p></div><div class=foot1><p>the same everywhere</p></div>"
    rows = [(k, "http://big/x", common_.format(k)) for k in range(400)]
    rows += [(1000 + k, "http://big/y", rare.format(k, f"<p>Teaser {k}</p>" if k % 2 else "")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = {k: f"Post {k}\nBody text of the post {k}" for k in range(400)}
    want |= {1000 + k: f"Guide {k}\nA long guide that only few pages have {k}" for k in range(6)}
    assert got == want


def test_constant_texts_are_no_content(spark):
    """A notice longer than the article, the same on all pages, is told from it wherever its pages are read."""
    page = "<body><div class=xa><p>{0}</p></div><div class=xb><p>Short {1}</p></div>"
    rows = [(k, "http://h/", page.format("the same long words " * 9, k)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    assert {(r["page_id"], r["text"]) for r in pages.extract_pages(df).collect()} == {(k, f"Short {k}") for k in range(20)}


def test_packed_wrapper():
    wrapper = pages.infer([ROOM % ("article", k, k, "<p>More.</p>" * k, "article") for k in range(3)] + ["<div>" * 3000 + "x"])
    again = pages._unpacked(pages._packed(wrapper))
    assert pages._packed(again) == pages._packed(wrapper) and pages.best_path(again) == pages.best_path(wrapper)


def test_pages_of_odd_rows(spark):
    rows = [(1, "http://a/x", "<p>x</p>"), (1, "http://a/x", "<p>x</p>"), (2, None, "<p>y</p>"), (3, "no host", None), (None, "http://a/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text")
    got = sorted((r["page_id"] or 0, r["text"]) for r in pages.extract_pages(df).collect())
    assert got == [(0, ""), (1, "x"), (1, "x"), (2, "y"), (3, "")]
    assert pages.extract_pages(df.limit(0)).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------


def test_near_copies_go_by_row(spark):
    """A repeated id with different texts, and copies without an id."""
    text = lambda *x: " ".join(f"{a}{k}" for a in x for k in range(60))
    near = text("a").replace("a30", "z")
    rows = [(1, text("a")), (5, near), (5, text("b")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("a")), (None, text("e")), (None, text("e")), (9, None), (None, "")]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs(spark, rows).repartition(3), SF)
    assert kept.columns == docs(spark, rows).columns
    want = [(1, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (9, None), (None, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, want))


def test_pipeline_stage_by_stage(spark, tmp_path):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = now.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, now)
        assert k == 4 or now.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    bad = ids(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0"))
    before, after = seen["quality classifier"]
    assert not bad & ids(after) and len(ids(after)) >= 0.75 * len(ids(before))
    before, after = seen["n-gram Jaccard join"]
    texts = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == {c for *_, c in brute_components(texts, 5, 80, 100)}
    before, after = seen["benchmark decontamination"]
    leaked = ids(decontaminate.mark_leaks(before, bench).filter(F.size("leak_spans") > 0))
    assert ids(after) == ids(before) - leaked and leaked
    before, after = seen["mixing sources to target weights"]
    assert ids(after) <= ids(before) and after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    before, after = seen["sharding"]
    assert after.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == after.count()
