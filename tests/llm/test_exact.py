"""Operators 2, 4, 8 and 10 against DuckDB and plain Python, and on odd tables."""

import glob
import hashlib
import random
import shutil
import zlib
from collections import Counter

import duckdb
import pytest

from graphloom.llm import chat, common, dedup, mixing, queries, sharding
from tests.conftest import SF, rows_of, same_as_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Same text", "en", "a", 1), (2, "sAME text", "en", "a", 1), (3, None, "en", None, 0), (4, "", None, "b", 0), (5, "É", "fr", "b", 1),
    (6, "é", "fr", "b", 1), (7, "word " * 30_000, "en", "b", 9), (7, "word " * 30_000, "en", "b", 9), (None, "Same text", "en", "", 1), (9, " \t\n", "en", "c", 3),
]


def docs(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS size", "2 AS _bucket", "'x' AS kept", "3 AS total", "4 AS cid") if extra else df


@pytest.mark.parametrize("name", [k for k in queries.ORACLES if k != "op8_sharding"])
def test_query_equals_sql(spark, name):
    same_as_sql(queries.QUERIES[name](spark, SF), queries.ORACLES[name])


def test_sharding_equals_sql(spark, tmp_path):
    short = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2000")
    short.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    shutil.copy(glob.glob(f"{tmp_path}/d/*.parquet")[0], tmp_path / "documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path)).toPandas()
    want = db.execute(sharding.OP8_SQL).df()
    assert rows_of(got) == rows_of(want)


def test_dedup_brute_force(spark):
    got = dedup.exact_dedup(docs(spark)).collect()
    assert len(got) == len(ODD)
    low = lambda t: (t or "").encode().lower()
    groups = Counter(low(r[1]) for r in ODD)
    ids = {}
    for r in ODD:
        if r[0] is not None:
            ids[low(r[1])] = min(ids.get(low(r[1]), 1 << 60), r[0])
    shas = {hashlib.sha256(k).hexdigest(): k for k in groups}
    for r in got:
        body = shas[r["text_sha256"]]
        assert r["group_size"] == groups[body] and r["keep_id"] == ids[body] and r["kept"] == (r["doc_id"] == r["keep_id"])
    largest = {r["doc_id"]: r["keep_id"] for r in dedup.exact_dedup(docs(spark), keep="largest").collect()}
    assert largest[1] == 2 and largest[3] == 4


def test_dedup_null_ids_only(spark):
    got = dedup.exact_dedup(docs(spark, [(None, "a", "en", "s", 1)] * 3)).collect()
    assert [(r["keep_id"], r["kept"], r["group_size"]) for r in got] == [(None, True, 3)] * 3


def test_dedup_finds_equal_texts_with_one_long_head(spark):
    rows = [(k, "head " * 100 + str(k // 2), "en", "s", 1) for k in range(400)]
    got = dedup.exact_dedup(docs(spark, rows)).collect()
    assert all(r["group_size"] == 2 and r["keep_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_mix_water_filling(spark):
    rows = [(k, "w " * n, "en", s, 1) for k, (s, n) in enumerate([("a", 10), ("b", 500), ("c", 490), ("d", 0)])]
    got = {r["source"]: r for r in mixing.source_targets(mixing_sized(spark, rows)).collect()}
    assert got["a"]["target"] == 30.0 and got["d"]["target"] == 0.0  # capped at three times
    assert sum(r["target"] for r in got.values()) == pytest.approx(1000)
    assert got["b"]["target"] / got["c"]["target"] == pytest.approx(2.0)


def mixing_sized(spark, rows):
    return spark.createDataFrame([(r[3], len(r[1].split())) for r in rows], "source string, size long")


def test_mix_emits_what_it_counts(spark):
    rows = [(k, f"w{k} " * (5 + k % 7), "en", "abc"[k % 3], 1) for k in range(3000)]
    df = docs(spark, rows)
    counted = {r["doc_id"]: r["mix_copies"] for r in mixing.mixed_counts(df).collect()}
    made = mixing.mix(df)
    assert made.columns == df.columns
    assert Counter(r["doc_id"] for r in made.select("doc_id").collect()) == Counter({k: v for k, v in counted.items() if v})
    again = mixing.mixed_counts(df.repartition(7)).collect()
    assert {r["doc_id"]: r["mix_copies"] for r in again} == counted and max(counted.values()) <= 3
    for s in "abc":
        own = [r for r in mixing.mixed_counts(df).collect() if r["source"] == s]
        assert sum(r["mix_size"] * r["mix_copies"] for r in own) == pytest.approx(own[0]["mix_target"], rel=0.08)


def test_mix_of_odd_rows(spark):
    got = mixing.mixed_counts(docs(spark)).collect()
    assert len(got) == len(ODD) and {r["source"] for r in got} == {"a", "b", "c", "", None}
    assert all(r["mix_copies"] == 0 for r in got if r["mix_size"] == 0 and r["mix_source_size"] == 0)


def test_mix_keeps_clashing_columns(spark):
    df = docs(spark, [(k, "w " * 9, "en", "ab"[k % 2], 1) for k in range(40)]).selectExpr("*", "7 AS mix_size", "8 AS MIX_copies", "9 AS _copy", "10 AS _rate", "'t' AS `mix_target`")
    for made in (mixing.mix(df), mixing.mixed_counts(df)):
        assert made.columns[: len(df.columns)] == df.columns
        assert {(r["mix_size"], r["MIX_copies"], r["_copy"], r["_rate"], r["mix_target"]) for r in made.collect()} == {(7, 8, 9, 10, "t")}
    assert {r["mix_size_"] for r in mixing.mixed_counts(df).collect()} == {9}


def test_prefix_sums_of_many_ranges_and_hot_keys(spark):
    """A thousand ranges; an id and null that a third of the rows hold each."""
    rng = random.Random(1)
    rows = [(rng.choice([None, 5, rng.randrange(400)]), rng.randrange(1 << 32), rng.randrange(9)) for _ in range(4000)]
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert common.bucket_count(spark) == 1000
        df = spark.createDataFrame(rows, "k long, t long, v long")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4")
        got = common.prefix_sums(df, "k", "t", "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(got, key=lambda r: r["position"])
    assert [(r["k"], r["t"]) for r in got] == [r[:2] for r in ordered] and [r["position"] for r in got] == list(range(4000))
    assert [r["before"] for r in got] == [sum(r[2] for r in ordered[:k]) for k in range(4000)]


def test_shards_are_contiguous_and_near_equal(spark):
    rows = [(k, "x" * (k * 37 % 900), "en", "s", 1) for k in range(2000)]
    got = sorted(sharding.shard(docs(spark, rows)).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode()) and r["size"] == len(rows[r["doc_id"]][1]) + 16
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * 916
    assert all(s == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    got = sharding.shard(docs(spark)).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (3, 4)} == {16}


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "<|im_start|>be <\\|nice"), (1, 1, "user", "hi\n\n<|im_end|>"), (1, 2, "assistant", "a" * 900), (1, 3, "user", None),
        (1, 4, "assistant", "tail <\\\\| é"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 5, "assistant", ""), (3, None, "ro\\n\nle", "é" * 5000), (3, 1, "assistant", "z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS block", "2 AS stop")
    for budget, history in ((2048, 256), (64, 16)):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df, budget, history)).collect()}
        for conv in (1, 2, 3, None):
            own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
            body = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
            loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
            assert got[conv]["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest() and got[conv]["n_turns"] == len(own)
            assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)


def test_chat_repeats_system_and_history(spark):
    turns = [(1, 0, "system", "S" * 40), *[(1, k, "user" if k % 2 else "assistant", "t" * 200) for k in range(1, 30)]]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = sorted(chat.format_windows(df, 256, 64).collect(), key=lambda r: r["start"])
    assert len(windows) > 5 and all(w["formatted"].startswith("<|im_start|>system\n") for w in windows)
    assert all(w["n_context"] >= 2 for w in windows[1:]) and windows[0]["n_context"] == 0
    assert sum(len(w["loss"]) for w in windows) == 14


def test_chat_keeps_its_budget(spark):
    """System, history and own turns: within the budget unless the system turn and one other turn exceed it."""
    rng = random.Random(4)
    turns, size = [], lambda t: (len(t.encode()) + 3) // 4 + 4
    for conv in range(60):
        if conv % 3:
            turns.append((conv, 0, "system", "s" * rng.choice([1, 40, 300, 700, 1100])))
        turns += [(conv, k, rng.choice(["user", "assistant"]), "t" * rng.choice([0, 9, 90, 250, 500, 900, 1500])) for k in range(1, rng.randint(2, 60))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for budget, history in ((256, 64), (256, 0), (256, 250), (4096, 256)):
        over = 0
        for w in chat.format_windows(df, budget, history).collect():
            own = [t for t in w["formatted"].split("<|im_start|>")[1:]]
            tokens = [size(t.split("\n", 1)[1].removesuffix("<|im_end|>\n")) for t in own]
            assert sum(tokens) == w["n_tokens"]
            system = next((size(t[3]) for t in turns if t[0] == w["conv_id"] and t[2] == "system"), 0)
            if w["n_tokens"] > budget:
                over += 1
                assert system >= budget or system + max(tokens[w["n_context"] :]) > budget and len(tokens) - w["n_context"] == 1 and w["n_context"] <= 1
        assert over or budget > 500
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df, budget, history)).collect()}
        for conv, r in got.items():
            body = "".join(f"{t[2]}\n{t[3]}\n" for t in turns if t[0] == conv)
            assert r["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest()


@pytest.mark.parametrize("f", [dedup.exact_dedup, mixing.mixed_counts, mixing.mix, sharding.shard])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0
