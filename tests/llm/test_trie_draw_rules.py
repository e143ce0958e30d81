"""Prefix trie, importance resampling and decision lists: brute force, SQL, odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import decision_list, importance, prefix_trie, queries

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
TURNS = "conv_id long, turn long, role string, text string, pos string, key int, size int, rep string, node string, row string"
ODD = [None, "", " \t\n", "!!!", "one", "a b c d e", "a b c d e", "é" * 3, " x\x85y", "w " * 30_000, "日本 語", "one"]
CLASH = "doc_id long, text string, w string, h int, stats string, judged string, found int, features int, row string, id string, bucket int, n_words int, score string"


def odd_docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 1, None, "y", 2, 3, None, None, 4, 5, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


# --- prefix trie -----------------------------------------------------------------------------------------

def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(path))
        up = members[path[:-1]][0] if path else None
        out.append((own[0], len(path), up, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turn_rows(convs):
    return [(c, k, r, t, "p", 1, 2, "r", "n", "w") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]


def test_trie_equals_brute_force(spark):
    rng = random.Random(7)
    convs = {}
    for c in range(60):
        convs[rng.randrange(-500, 100_000)] = [(rng.choice(["user", "bot"]), rng.choice(["a", "é日", "", "hello"])) for _ in range(rng.randrange(1, 6))]
    for c in range(100_000, 100_040):
        convs[c] = [("user", "copy"), ("bot", "of one"), ("user", "conversation")]
    long = [("user", f"turn {k}") for k in range(12)]
    convs[200_000], convs[200_001], convs[200_002] = long, long + [("bot", "more")], long[:5] + [("bot", "other")] * 20
    rows = turn_rows(convs)
    rng.shuffle(rows)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3))
    assert got.schema.simpleString() == spark.createDataFrame([], prefix_trie.TRIE).schema.simpleString()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(convs)


def test_trie_of_odd_turns(spark):
    """Null turns first, equal turns by role and text, null role and text empty, no conv_id: no conversation, repeated rows are turns."""
    rows = [
        (1, 5, "user", "late"), (1, None, None, None), (1, 5, "bot", "z"), (1, 5, "bot", "a"),
        (2, 0, "", ""), (None, 0, "user", "nobody"), (3, 1, "user", "x"), (3, 1, "user", "x"),
    ]
    t = spark.createDataFrame([(*r, "p", 1, 2, "r", "n", "w") for r in rows], TURNS)
    convs = {1: [("", ""), ("bot", "a"), ("bot", "z"), ("user", "late")], 2: [("", "")], 3: [("user", "x"), ("user", "x")]}
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(t).collect()), key=str) == brute_trie(convs)
    assert prefix_trie.prefix_trie(t.limit(0)).collect() == []
    one = {9: [("user", "only"), ("bot", "one")]}
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(turn_rows(one), TURNS)).collect()), key=str) == brute_trie(one)


def test_one_long_conversation_lies_in_many_tasks(spark):
    n = 3000
    t = spark.range(n).select(F.lit(4).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("ab"), (F.col("id") % 3).cast("int")).alias("text"))
    rows = prefix_trie.ranked(t).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, n + 1))
    assert [r.upto for r in rows] == list(np.cumsum([2 * (k % 3) for k in range(n)]))
    nodes = prefix_trie.prefix_trie(t)
    assert nodes.count() == n + 1 and nodes.agg(F.sum("n_leaves")).first()[0] == n + 1


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def test_shared_heads_with_absent_lenders_and_no_turns_left(spark, tmp_path):
    rng = random.Random(3)
    convs = {c: [(rng.choice("ub"), rng.choice(["s", "tt"])) for _ in range(rng.randrange(1, 8))] for c in [*range(0, 40), *range(310, 330), 200, 201]}
    rows = [r[:4] for r in turn_rows(convs)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(convs)
    assert any(not t for t in want.values()) and any(c not in convs for c in (300,))
    got = queries.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(want)


def test_running_digest_over_many_lists():
    import pandas as pd

    rows = [("1", "2", 3, 4, k) for k in range(5000)] + [("1", "3", 3, 4, 7)]
    frame = pd.DataFrame(rows, columns=["s1", "s2", "length", "total", "conv_id"])
    lists = list(prefix_trie._lists(iter([frame[:1500], frame[1500:4000], frame[4000:]])))
    assert max(x["n"].max() for x in lists) <= prefix_trie.LIST_IDS
    got = pd.concat(prefix_trie._digests(iter(lists)))
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert got.values.tolist() == [[0, 5000, 3, 4, want], [7, 1, 3, 4, hashlib.sha256(b"7").hexdigest()]]


# --- importance resampling -------------------------------------------------------------------------------

def brute_draw(texts, ids, target, grams=(1, 1), buckets=10_000, percent=10, least=20):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        f = [" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in f]

    docs = [found(t) for t in texts]
    s, t = collections.Counter(b for _, f in docs for b in f), collections.Counter(b for x in target for b in found(x)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for (n, f), i in zip(docs, ids, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("options", [{}, {"grams": (1, 3), "buckets": 97, "percent": 50, "least_words": 2}])
def test_resampling_equals_brute_force(spark, options):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["Alpha", "beta", "GAMMA9", "déjà", "日本", "x-y", "the"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts, ids = texts + ODD, list(range(150)) + [None, 5, 5, None] + list(range(150, 158))
    target = ["the alpha beta", None, "", "déjà vu the the"]
    got = importance.resample(odd_docs(spark, texts, ids), odd_docs(spark, target), **options)
    asked = {"least" if k == "least_words" else k: v for k, v in options.items()}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(texts, ids, target, **asked)


def test_resampling_of_empty_tables(spark):
    none, some = odd_docs(spark, []), odd_docs(spark, ["a b " * 30, None])
    assert importance.resample(none, some).collect() == []
    assert sorted((tuple(r) for r in importance.resample(some, none, percent=100).collect()), key=str) == brute_draw(["a b " * 30, None], [0, 1], [], percent=100)


@needs_tables
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance"])
def test_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


# --- decision lists --------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "c|", "é日", "#*", "", "\t", "x y"]) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ODD
    rules = decision_list.DecisionList()
    rows = decision_list.judge(odd_docs(spark, texts), rules, as_col="said").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.w, r.h, r.stats, r.found, r.score) == ("x", 1, None, 2, "s")  # other columns stay
        counts = brute_counts(texts[r.doc_id])
        assert tuple(r.said[:5]) == counts, texts[r.doc_id][:80]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.said.base_failed == failed and r.said.kept == (not failed) and (r.said.reason is None) == failed


def test_filters_on_verdicts_do_not_repeat_the_statistics(spark):
    judged = decision_list.judge(odd_docs(spark, ["a b c d " * 2000] * 3), decision_list.DecisionList(), as_col="said")
    some = judged.where("not said.base_failed and said.kept and said.n_words > 5 and said.n_repeat_words < 3")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("sort_array") == 2
    assert some.count() == 0 and judged.where("said.n_words = 8000").count() == 3


def test_list_finds_planted_rules_and_says_what_its_column_says(spark):
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(decision_list.FEATURES)))
    good = ~((x[:, 2] > 0.7) & (x[:, 4] > 0.5)) & (x[:, 8] <= 0.9)
    rules = decision_list.learn(x, good)
    assert 1 <= len(rules.rules) <= decision_list.MOST_RULES
    assert all(r.precision >= decision_list.SURE and r.covered >= decision_list.LEAST_COVER for r in rules.rules)
    fresh = rng.random((2000, x.shape[1]))
    truth = ~((fresh[:, 2] > 0.7) & (fresh[:, 4] > 0.5)) & (fresh[:, 8] <= 0.9)
    said = rules.decide(fresh)
    assert (said == truth).mean() > 0.97
    order = rng.permutation(len(x))
    assert [str(r) for r in decision_list.learn(x[order], good[order]).rules] == [str(r) for r in rules.rules]
    rows = spark.createDataFrame([(i, [float(v) for v in f]) for i, f in enumerate(fresh[:300])], "i int, f array<double>")
    got = rows.select("i", rules.keep(F.col("f")).alias("k"), rules.reason(F.col("f")).alias("why")).collect()
    assert all(r.k == said[r.i] and ("keep" in r.why) == r.k for r in got)


def test_list_without_labels_keeps_all_and_one_class_is_its_default(spark):
    x = np.zeros((10, len(decision_list.FEATURES)))
    assert decision_list.learn(x[:0], np.zeros(0)).default is True
    assert decision_list.learn(x, np.ones(10)).rules == [] and decision_list.learn(x, np.zeros(10)).default is False
    noise = np.random.default_rng(1)
    found = decision_list.learn(noise.random((400, x.shape[1])), noise.random(400) < 0.5)
    assert len(found.rules) <= 2  # labels that statistics say nothing about teach next to nothing
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = decision_list.fit(odd_docs(spark, ["a b c", "d", "e", "f"], [0, 0, 1, None]), labels)
    assert model.rules == [] and model.default is True
    assert decision_list.fit(odd_docs(spark, []), labels.limit(0)).rules == []


def test_sample_of_labels_is_bounded(spark):
    docs = odd_docs(spark, ["some text"] * 200, [k % 4 for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    seen = []
    real, decision_list.learn = decision_list.learn, lambda x, good: seen.append(len(x)) or real(x, good)
    try:
        decision_list.fit(docs, labels, sample_rows=5)
    finally:
        decision_list.learn = real
    assert seen and seen[0] <= 10


@needs_tables
def test_rules_agree_with_labels_they_have_not_seen(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rules = decision_list.fit(docs, labels.where(~held))
    judged = decision_list.judge(docs, rules).join(labels.where(held), "doc_id").where("not judged.base_failed")
    rows = judged.select("quality", "judged.kept").collect()
    assert len(rows) > 80 and np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


@needs_tables
def test_query_of_rules_judges_every_document(spark):
    rows = queries.op13_quality_rules(spark, DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    plan = queries.op13_quality_rules(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
