"""Operators for training data: against the libraries, brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulse.llm import fingerprints, idfile, language, learning, mixing, neardup, packing, quality, rules, tokens, toxicity
from pulse.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, `sketch` int"
ODD = [
    "", " ", "  a  b \n c", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "foo\xa0 bar　baz\x1c q",
    "I've don't 'sure !'s  \t\n", "İstanbul Å é J̌ ΣΑΣ", "日本語 テスト 123", "a\x85 b\x0b c", "x" * 5000, "one",
]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [*ODD, None, None, long, "same text of a few words here", "same text of a few words here"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id at all", None, None, 1, "x", 1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return llm.documents(spark, folder)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def ids_of(text, end):
    encoder = tokens.WordIds.shared("word_bpe_49k.json").library
    return encoder.encode(text, add_special_tokens=False).ids + [end]


def test_encoders_equal_the_library(docs):
    texts = ODD + [t for _, t in texts_of(docs)][:300]
    counter = tokens.PieceCounts.shared("byte_bpe_50k.json").library
    found = tokens.token_counts(pa.array(texts), "byte_bpe_50k.json")
    assert found.tolist() == [len(counter.encode(t, add_special_tokens=False)) for t in texts]
    for group in (texts, *([t] for t in ODD)):
        ids, ends = tokens.token_ids(pa.array(group), "word_bpe_49k.json", 2)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t, 2) for t in group]


def test_count_tokens_edges(edges, empty):
    rows = tokens.count_tokens(edges).collect()
    assert len(rows) == edges.count() and tokens.count_tokens(empty).count() == 0
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 11, 12)} == {0}


@pytest.mark.parametrize("name", ["docs", "edges"])
def test_packing_keeps_every_id_once(name, request):
    table = request.getfixturevalue(name)
    rows = packing.pack(table).collect()
    expected = sorted((d if d is not None else -1, zlib.crc32(np.array(ids_of(t, 1), "<u4"))) for d, t in texts_of(table))
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids)
        sequences[r.sequence_id].append(r)
        whole[r.doc_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size <= 2048 and size & (size - 1) == 0  # nothing is padded
    if name == "docs":
        found = []
        for doc, own in whole.items():
            own.sort(key=lambda r: r.start)
            data = b"".join(r.ids for r in own)
            assert len(data) == 4 * own[0].doc_tokens
            found.append((doc, zlib.crc32(data)))
        assert sorted(found) == expected
    assert sum(r.length for r in rows) == sum(len(ids_of(t, 1)) for _, t in texts_of(table))


def test_packing_balances_steps_and_takes_an_empty_table(spark, docs, empty):
    """Every step holds 16 windows or so, over batches of 40 rows, but for the last step or two of a task."""
    step, key = 16 * 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        packed = packing.pack(docs.repartition(3), step_tokens=step)
        task = F.shiftright("step_id", 33).alias("task")
        loads = packed.groupBy(task, "step_id").agg(F.sum("length").alias("n"), F.countDistinct("tier").alias("tiers")).collect()
    finally:
        spark.conf.set(key, old)
    tasks = defaultdict(list)
    for r in sorted(loads, key=lambda r: r.step_id):
        tasks[r.task].append(r.n)
    assert len(tasks) == 3 and max(map(len, tasks.values())) > 4
    for sizes in tasks.values():
        assert all(abs(n - step) <= 2048 for n in sizes[:-2])
        assert all(0.7 * step <= n <= 1.5 * step + 2048 for n in sizes[-2:]) or len(sizes) == 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("size", [1, 7, 8, 1000])
def test_planes_round_trip(kind, size):
    ids = np.random.default_rng(size).integers(0, 2**32, size, np.uint32)
    assert (idfile.from_planes(idfile.to_planes(ids, kind), size, kind) == ids).all()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_id_files_round_trip(spark, edges, empty, block, tmp_path):
    idfile.write_ids(edges, str(tmp_path / "a"), block=block, kind="bit" if block == 64 else "byte")
    rows = sorted(idfile.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    order = sorted(texts_of(edges), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [ids_of(t, 2) for _, t in order]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    idfile.write_ids(empty, str(tmp_path / "b"))
    assert idfile.read_ids(spark, str(tmp_path / "b")).count() == 0


def brute_groups(texts, words, percent):
    sets, parent = {}, {}
    for doc, text in texts:
        own = text.encode().lower().split()
        runs = [tuple(own[i : i + words]) for i in range(len(own) - words + 1)] or ([tuple(own)] if own else [])
        sets[doc], parent[doc] = set(runs), doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    a_, b_ = root(a), root(b)
                    parent[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies():
    """Chains and groups of edited copies of sizes around every bound, with a passage that all share."""
    rng, texts = random.Random(3), []
    passage = [f"p{i}" for i in range(30)]
    for size in (1, 2, 3, 6, 12, 30, 90, 400):
        for family in range(4):
            base = [f"{size}-{family}-{rng.randrange(400)}" for _ in range(size)] + (passage if family == 0 else [])
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, size // 12, size // 11, size // 10, size // 9, size // 4):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
    return [*enumerate(texts, 10), (3, None), (4, " \n "), (5, "Word"), (6, "wORD")]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rows = near_copies()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in neardup.near_duplicates(table, words).collect()}
    expected = brute_groups([(d, t or "") for d, t in rows], words, 80)
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    table = spark.createDataFrame(near_copies()[:120], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(table).collect()}
    expected = brute_groups([(d, t or "") for d, t in near_copies()[:120]], 2, 80)
    assert found == {d: c for d, (_, c) in expected.items()}


def test_small_sets_have_a_list_in_common():
    """Random pairs of every size up to 38 and of just enough likeness: all share a list."""
    rng, tried = np.random.default_rng(5), 0
    for n in range(4, 39):
        for other in range(ceil(0.8 * n - 1e-9), n + 1):
            common = ceil(0.8 * (n + other) / 1.8 - 1e-9)
            if common > other:
                continue
            for _ in range(60 if n > 15 else 600):
                values = rng.integers(0, 2**63, n + other - common, dtype=np.uint64)
                a, b = np.sort(values[:n]), np.sort(values[n - common :])
                assert set(neardup.list_keys(a, 0.8).tolist()) & set(neardup.list_keys(b, 0.8).tolist()), (n, other)
                tried += 1
    assert tried > 10_000


def test_short_texts_cut_at_the_end_are_linked(spark):
    """Pairs of 5:4 and 10:8 shingles, each a likeness of 0.8."""
    rows = []
    for k in range(2000):
        n, cut = ((6, 1), (11, 2))[k % 2]
        text = [f"{k}x{i}" for i in range(n)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:-cut]))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 4000 and {r.component_id - r.doc_id // 2 * 2 for r in found} == {0}


def test_near_duplicates_with_unlike_sketches(spark):
    """A text and 0.8 of it, of whose 64 least values 28 went: the estimate is 36 / 64."""
    words = {int(next(neardup.shingle_sets(pa.array([w]), 1))[0]): w for w in (f"w{i}" for i in range(500))}
    order = sorted(words)
    gone = [v for v in order[:64] if v % 32 >= 8][:28]
    gone = set(gone + order[-72:])
    texts = [" ".join(words.values()), " ".join(w for v, w in words.items() if v not in gone)]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [v.tobytes() for v in neardup.shingle_sets(pa.array(texts), 1)]
    assert [len(v) // 8 for v in sets] == [500, 400]
    assert {r.component_id for r in neardup.near_duplicates(table, 1).collect()} == {0}
    sketches = [(i, np.frombuffer(v, np.int64)[: neardup.SKETCH].tolist()) for i, v in enumerate(sets)]
    sketches = spark.createDataFrame(sketches, "id long, sketch array<long>")
    members = [(7, i, i, len(v) // 8) for i, v in enumerate(sets)]
    members = spark.createDataFrame(members, "key long, id long, component long, n long")
    wide = neardup.wide_sketches(table, members, 1)
    for lists in (members, neardup.parted(members, sketches, 0.8)):
        assert [tuple(r) for r in neardup.links_in_lists(neardup.sided(lists), wide, 0.8).collect()] == [(0, 1, False)]


def test_values_in_common_are_counted(monkeypatch):
    """Against multisets, and over several parts of the columns."""
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    lists = [np.sort(rng.integers(-40, 40, rng.integers(0, 60))).astype(np.int32) for _ in range(30)]
    found = neardup.values_in_common(np.concatenate(lists), np.array([*map(len, lists)]))
    counts = [Counter(x.tolist()) for x in lists]
    for i, a in enumerate(counts):
        assert all(sum((a & b).values()) == found[i, j] for j, b in enumerate(counts) if i != j)


def test_lists_reject_sets_of_middle_size_for_certain(spark):
    """Sets of 100 to 250 values around a likeness of 0.8, each its own component in one list: the pairs that are alike."""
    rng, texts = random.Random(8), []
    for base in range(6):
        words = [f"{base}x{i}" for i in range(rng.randrange(100, 250))]
        texts += [" ".join(w if rng.random() > 0.055 else f"{w}y{k}" for w in words) for k in range(12)]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    members = [(7, i, i, len(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(members, "key long, id long, component long, n long")
    found = neardup.links_in_lists(neardup.sided(members), neardup.wide_sketches(table, members, 1), 0.8)
    assert 20 < len(pairs) < 380 and sorted(tuple(r) for r in found.collect()) == sorted((*p, False) for p in pairs)


def test_near_duplicates_edges(edges, empty):
    rows = neardup.near_duplicates(edges).collect()
    assert len(rows) == edges.count() and neardup.near_duplicates(empty).count() == 0
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = neardup.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and {15} == {r.doc_id for r in edges.collect()} - {r.doc_id for r in kept.collect()}


def test_fingerprints_follow_the_texts(spark, folder, docs):
    found = {r.doc_id: r for r in llm.QUERIES["op7_bottom_k_fingerprints"](spark, folder).collect()}
    order = sorted(texts_of(docs), reverse=True)

    def shingles(text):
        words = text.encode().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    for k, (doc, text) in enumerate(order):
        following, third, r = order[(k + 1) % len(order)][1], len(text) // 3, found[doc]
        edited = text[: len(text) - third] + following[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(text), shingles(other)
            assert abs(near - len(a & b) / len(a | b)) < 0.3


def test_fingerprints_merge_and_edges(spark, edges, empty):
    rows = fingerprints.fingerprint_edits(edges).collect()
    assert len(rows) == edges.count() and fingerprints.fingerprint_edits(empty).count() == 0
    assert all(0 <= r.near_next <= 1 and r.n_chars is not None for r in rows)
    parts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(a, a + 2000))) for a in (0, 1000)], "k int, text string")
    parts = parts.withColumn("sketch", fingerprints.sketch(F.col("text"), 256))
    whole = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3000)))], "k int, text string")
    whole = whole.select("k", fingerprints.sketch(F.col("text"), 256).alias("whole"))
    both = fingerprints.merge_sketches(parts, "k", k=256).join(whole, "k")
    r = both.select("sketch", "whole", fingerprints.distinct_shingles(F.col("whole"), 256).alias("n")).first()
    assert len(set(r.sketch) & set(r.whole)) > 245 and abs(r.n - 2996) < 600


def test_short_lines_need_a_closing_mark():
    """Headings and link titles go, whatever closes them in Unicode stays, long lines need no mark."""
    limits, good = rules.Limits(), "the river ran slowly past the old mill and nobody saw it go down there today"
    for line, verdict in [
        ("Ten great places", "unclosed"), ("Ten great places.  ", ""), ("Ten great places…", ""), ("「ten」 great 。", ""), (good, ""),
        ("a b c d e f g h i", "unclosed"), ("a b c d e f g h i j", ""), ("said »so«", "unclosed"), ("said «so»", ""),
    ]:
        data = line.encode()
        assert rules.line_verdict(data, data.split(), set(), limits) == verdict
    titles = "\n".join(f"Story number {k} of many" for k in range(12))
    body = "\n".join(" ".join(f"{word}{k}" for word in good.split()) + "." for k in range(12))
    assert not rules.clean(titles)["kept"] and rules.clean(body)["kept"]
    mixed = rules.clean(titles.split("\n")[0] + "\n" + body)
    assert mixed["kept"] and mixed["cleaned"] == body and mixed["lost_words"] == 5


def test_base_counts_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", "#", "|", " ", " ", "\n", "\x0b", "\u2003", "\x1c"]) for _ in range(rng.randrange(120)))
        words = re.findall("[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, window in enumerate(windows) if windows.count(window) > 1 for k in range(3)}
        found = rules.clean(text)
        assert (found["n_words"], found["word_chars"], found["n_repeat_words"]) == (len(words), sum(map(len, words)), len(hit))
        assert found["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert found["n_dup_lines"] == len(lines) - len(set(lines))
        assert found["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_line_rules(edges, empty):
    rows = {r.doc_id: r for r in rules.clean_documents(edges).collect()}
    assert rules.clean_documents(empty).count() == 0 and not rows[11].kept
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(10))
    found = rules.clean(good + "\nHome | Login | Search\n" + good.split("\n")[0])
    assert found["kept"] and found["cleaned"] == good and found["n_dup_lines"] == 1 and found["lost_words"] == 17
    assert found["n_repeat_words"] == 24 and found["n_symbols"] == 2
    assert not rules.clean(good.upper())["kept"] and not rules.clean(good.replace(" ", "!! "))["kept"]
    assert rules.clean("üé 日\x0bx")["word_chars"] == 4


def accuracy(spark, folder, query, label, column):
    given = spark.read.parquet(f"{folder}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    rows = llm.QUERIES[query](spark, folder).filter("held_out").join(given, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return sum(r[column] == r[label] for r in rows) / len(rows)


def test_held_out_accuracy(spark, folder):
    assert accuracy(spark, folder, "op2_language_id", "lang", "lang_pred") > 0.97
    assert accuracy(spark, folder, "op9_quality_gam", "quality", "predicted") > 0.95
    assert accuracy(spark, folder, "op6_counterfactual_toxicity", "toxic", "predicted") > 0.9


def test_models_take_edges(spark, edges, empty):
    model = language.train(edges.withColumn("lang", F.coalesce("lang", F.lit("xx"))))
    found = {r.doc_id: r for r in language.identify(edges, model).collect()}
    assert found[0].lang_pred == found[11].lang_pred == "und" and language.identify(empty, model).count() == 0
    assert language.train(empty) is None and language.identify(edges, None).filter("lang_pred != 'und'").count() == 0
    none = edges.select("doc_id", F.lit(1).alias("label")).filter("false")
    given = edges.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    for module in (quality, toxicity):
        for labels in (none, given):
            assert module.score(edges, module.train(edges, labels)).count() == edges.count()


def test_counterfactual_training_leaves_group_mentions_alone():
    terms = ["women", "men", "immigrants"]
    present, labels = [], []
    for k in range(200):
        toxic = k % 2
        words = [f"w{k % 17}", terms[0] if toxic else "calm", *(["idiot"] if toxic else [])]
        present.append(np.unique([b for w in words for b in toxicity.word_features(w)]))
        labels.append(toxic)
    swaps = [(np.array(toxicity.word_features(t)), np.empty(0, np.int64)) for t in terms]
    change = []
    for fairness in (0.0, 5.0):
        model = toxicity.fit(present, swaps, np.array(labels, float), fairness=fairness)
        change.append(abs(model.weights[toxicity.word_features("women")].sum()))
    assert change[1] < 0.2 * change[0]


def test_mixing_meets_limit_and_keeps_rows(spark, edges, empty):
    rows = [(i, "big" if i < 600 else f"s{i % 4}", 10 + i % 7) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(table, "size", max_repeats=2.0)
    copies = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies) == set(range(1000)) and set(copies.values()) <= {1, 2, 3}
    sums = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    sizes = {r.source: r.n for r in table.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert max(sums[s] / sizes[s] for s in sizes) <= 2.0 + 1e-6 and min(sums[s] / sizes[s] for s in sizes) >= 1
    assert sums["s1"] / sizes["s1"] > 1.9 and sums["big"] == sizes["big"]
    assert mixing.mix(edges, "n_chars").count() >= edges.count() and mixing.mix(empty, "n_chars").count() == 0


def test_pipeline_stages(spark, folder, docs, tmp_path):
    rows, names = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, folder).write.parquet(str(tmp_path / str(k)))
        before, rows = rows, spark.read.parquet(str(tmp_path / str(k)))
        if stage is not corpus_pipeline.packing_stage:
            assert rows.columns == names, name
            assert rows.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or name == "source mixing"
        if name == "near-duplicate removal":
            texts = [(d, t) for d, t in texts_of(before)]
            kept = {d for d, (_, c) in brute_groups(texts, 5, 80).items() if d == c}
            assert {r.doc_id for r in rows.collect()} == kept
    total = sum(len(ids_of(t, 1)) for _, t in texts_of(before))
    assert rows.agg(F.sum("length")).first()[0] == total


@pytest.mark.parametrize("bound", [2, 90, 6000])
def test_samples_are_the_least_hashes_of_each_label(spark, bound):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    found = learning.bounded_sample(rows, bound).collect()
    hashed = sorted((r["hash"], r["doc_id"], r["label"]) for r in rows.withColumn("hash", F.xxhash64("doc_id")).collect())
    expected = [[d for _, d, given in hashed if given == label][: bound // 2] for label in (0, 1)]
    assert sorted(r["doc_id"] for r in found) == sorted(expected[0] + expected[1])
    assert learning.bounded_sample(rows.limit(0), bound).count() == 0
