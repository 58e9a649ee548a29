"""Resampling, the BPE transducer and the prefix trie: against plain versions and the tiktoken library."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from pulse.llm import ordered, prefixes, resampling, tokens, transducer
from pulse.llm import queries as llm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_numbered_carries_groups_over_tasks(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 9), k, rng.randrange(ordered.PRIME), rng.randrange(100)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, k long, h long, v long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = ordered.numbered(df, "g", [F.col("k")], sums=("v",), hashes=("h",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = defaultdict(list)
    for row in sorted(rows):
        groups[row[0]].append(row)
    expected = {}
    for g, own in groups.items():
        total = hashed = 0
        for place, (_, k, h, v) in enumerate(own):
            before = total, hashed
            total += v
            hashed = (hashed + h * pow(ordered.BASES[0], place, ordered.PRIME)) % ordered.PRIME
            expected[g, k] = (place + 1, total, before[0], hashed, before[1])
    assert {(r.g, r.k): (r.place, r.v, r.v_before, r.h, r.h_before) for r in got} == expected
    none = ordered.numbered(df.filter("false"), "g", [F.col("k")], sums=("v",))
    assert none.columns == ["g", "k", "h", "place", "v", "v_before"] and none.count() == 0


# Resampling


def plain_resampling(rows, target, percent, least, longest, buckets, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(run.encode()) % buckets for run in runs]

    found = [(doc, *features(text)) for doc, text in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, own in found:
        np.add.at(s, own, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc, n, own in found:
        key = f"{seed}:{'' if doc is None else doc}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = defaultdict(list)
    for rank, row in enumerate(able[:drawn], 1):
        ranks[row].append(rank)
    return sorted(((r[0], *r[2:], ranks[r].pop(0) if ranks[r] else None) for r in out), key=str)


EDGES = "doc_id long, text string, score string, row int, n_words string, `all` string"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, null ids, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))
    texts = ["", None, " ", long, "Ähm Café ÄHM it's 2x\x00y|z", "same words " * 12, "same words " * 12, "a b c " * 9, "one", "日本語 " * 25]
    rows = [(i, text, "x", 1, "y", None) for i, text in enumerate(texts)]
    rows += [(5, "same words " * 12, "x", 1, "y", None)] * 40 + [(None, "no id " * 15, "x", 1, "y", None)] * 6 + [(None,) * 6]
    return spark.createDataFrame(rows, EDGES).repartition(3).cache()


@pytest.mark.parametrize("percent,least,longest,buckets", [(10, 20, 1, 10_000), (50, 2, 3, 97)])
def test_resampling_equals_plain(spark, edges, percent, least, longest, buckets):
    target = ["same words here", None, "", "CAFÉ a b"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(edges, bench, percent, least, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = plain_resampling([(r.doc_id, r.text) for r in edges.collect()], target, percent, least, longest, buckets)
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_resampling_of_nothing(spark, edges):
    none = edges.filter("false")
    assert resampling.resample(none, none).count() == 0
    rows = resampling.resample(edges, none).collect()
    expected = plain_resampling([(r.doc_id, r.text) for r in edges.collect()], [], 10, 20, 1, 10_000)
    assert sorted(map(tuple, rows), key=str) == expected


def test_bisection_finds_exact_thresholds(spark):
    rng = random.Random(2)
    values = [rng.choice([-(2**63), -5, 0, 0, 0, 7, 2**63 - 1, rng.randrange(10**6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long").cache()
    down = sorted(values, reverse=True)
    for wanted in (1, 2, 77, 250, 499, 500):
        threshold = down[wanted - 1]
        assert resampling.bisected(df, "v", wanted) == (threshold, sum(v > threshold for v in values))


# Transducer


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    with open(tokens.tokenizer_path(transducer.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    out, held = [], []
    for _, ids, borders, over in transducer.encoded(pa.array(texts, pa.string())):
        for k, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            held += ids[a:b].tolist()
            if k < len(borders) - 2 or over:
                out.append(held)
                held = []
    return out


def test_transducer_equals_the_library_on_odd_texts(library):
    rng = random.Random(3)
    parts = [*"abcdeABC  \n\t'.,!0123éüßñ日本語テ́ 　\x1c\x85\x01한국ελλпри🙂👩‍👧", chr(0x558), chr(0x58B), chr(0x323B0), "'s", "'ll", " the", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [None, "", "a" * 50_000, " " * 5000 + "x", "x" * 1000 + " " * 1000, "word " * 400_000, "日本" * 20_000, "\n" * 3000, "<|endoftext|>"]
    assert ids_of(texts) == [library.encode_ordinary(text or "") for text in texts]


def test_transducer_with_ranks_that_do_not_grow():
    """A vocabulary whose wholes may come before their parts, or are never merged, goes by the plain rule."""
    rng = random.Random(8)
    for _ in range(30):
        words = {bytes(rng.choices(b"ab", k=rng.randint(2, 5))) for _ in range(9)}
        ranks = dict(zip([bytes([b]) for b in range(256)], range(256)))
        ranks |= {w: 256 + k for k, w in enumerate(rng.sample(sorted(words), len(words)))}
        own = tiktoken.Encoding("x", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
        machine = transducer.Transducer(ranks)
        pieces = ["".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(60)]
        expected = [own.encode_ordinary(p) for p in pieces]
        assert [machine.encode(p.encode()) for p in pieces] == expected
        many = machine.encode_many([p.encode() for p in pieces if p.encode() not in ranks])
        assert [np.frombuffer(m, "<u4").tolist() for m in many] == [e for p, e in zip(pieces, expected) if p.encode() not in ranks]


def test_long_pieces_keep_a_short_register(monkeypatch):
    machine = transducer.words_of(transducer.VOCABULARY).machine
    cuts = []
    plain = machine.settled
    monkeypatch.setattr(machine, "settled", lambda last: cuts.append(len(last)) or plain(last))
    machine.encode(b"abcdefgh" * 20_000)
    assert len(cuts) > 50 and max(cuts) < 4 * transducer.REGISTER


def test_decoder_equals_the_standard_one():
    rng = random.Random(4)
    decoder = transducer.Decoder({b: bytes([b]) for b in range(256)} | {256: "é🙂".encode(), 257: "é".encode()[:1]})
    tricky = [0x41, 0x80, 0xBF, 0xC1, 0xC3, 0xE0, 0x9F, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF, 256, 257]
    for _ in range(3000):
        ids = rng.choices(tricky, k=rng.randint(0, 12))
        data = b"".join(decoder.bytes_of[i] for i in ids)
        cut = rng.randint(0, len(ids))
        text = decoder.feed(np.array(ids[:cut], int)) + decoder.feed(np.array(ids[cut:], int)) + decoder.close()
        assert text == data.decode("utf-8", "replace")


def test_round_trip_edges(spark, edges, library):
    rows = transducer.round_trip(edges).collect()
    assert len(rows) == edges.count()
    expected = []
    for r in edges.select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        expected.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert transducer.round_trip(edges.filter("false")).count() == 0
    again = transducer.decode(transducer.encode(edges)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in again) == sorted((r.doc_id or -1, r.text or "") for r in edges.collect())


def test_bpe_query_equals_the_library(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in llm.documents(spark, folder).collect()}
    rows = llm.QUERIES["op12_bpe_transducer"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# Prefix trie


def plain_trie(rows, heads=9, family=5):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in own.items()}
    rebuilt, members, kids = {}, defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, family))
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for k in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:k]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].add(s)
    saved, leaves = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for k in range(len(s) + 1):
            saved[s[:k]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
            leaves[s[:k]] += not kids[s]
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(s))
        parent = min(members[s[:-1]]) if s else None
        out.append((min(m), len(s), parent, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth string, `low` int, place int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_plain(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(-12, 60), *range(200, 230)]:
        if rng.random() < 0.2:
            continue
        same = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 5, 12])):
            text = f"t{t}" if same else rng.choice(["", "é", "x", None, "long " * 30])
            rows.append((c, t, rng.choice(["user", "user", None]), text, "x", 1, 1))
    rows += [(7, None, None, "first", None, None, None), (None, 0, "user", "nobody", None, None, None)]
    rows += [(300, t, "user", f"{t % 7}", None, None, None) for t in range(120)]  # one very long conversation
    rows += [(c, 0, "user", "hi", None, None, None) for c in range(1000, 2500)]  # many equal ones
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = prefixes.prefix_trie(df)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie([r[:4] for r in rows])


def test_trie_of_repeated_rows_and_nothing(spark):
    rows = [(5, 0, "user", "a", None, None, None)] * 30 + [(6, None, None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, TURNS)
    assert sorted(map(tuple, prefixes.prefix_trie(df).collect()), key=str) == plain_trie([r[:4] for r in rows])
    assert prefixes.prefix_trie(df.filter("false")).count() == 0


# Mended operators


def test_common_passage_brings_nobody_together(spark):
    """Texts that share a passage, none alike: long lists are parted by rare values, so no pairs are made of them."""
    from pulse.llm import neardup

    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, passage + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(18))) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(20)]  # and some near copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {k: k - 5000 if k >= 5000 else k for k, _ in rows}
    signed = neardup.signatures(df, 2, 0.8).select(F.col("doc_id").alias("id"), "n", "sketch", F.col("doc_id").alias("component"))
    one = signed.select(F.lit(1).cast("long").alias("key"), "id", "component", "n")
    parts = neardup.sided(neardup.parted(one, signed.select("id", "sketch"), 0.8))
    assert parts.select("id").distinct().count() == 40 and parts.agg(F.max(F.col("mains") + F.col("outs"))).first()[0] == 2


def test_toxicity_scores_are_the_models(spark, folder):
    from pulse.llm import toxicity

    docs = llm.documents(spark, folder).limit(300)
    rng = np.random.default_rng(1)
    weights = np.where(rng.random(toxicity.BUCKETS) < 0.2, rng.normal(size=toxicity.BUCKETS), 0) / 10
    model = toxicity.ToxicityModel(weights, -0.3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    odd = pa.array(["idiot", "idiot, idiot. \"idiot\"", "idiots idiotic", "", None, "1 2 3"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs = [(t, got[k]) for k, t in texts.items()] + [*zip(odd.to_pylist(), model.scores(odd))]
    for text, score in pairs:
        buckets = {b for word in (text or "").lower().split() for b in toxicity.word_features(word)}
        assert score == pytest.approx(1 / (1 + math.exp(0.3 - sum(weights[b] for b in buckets))), abs=1e-12)


def test_training_makes_swapped_terms_alike(spark):
    """Labelled sentences in which one group's terms come with toxic words: the penalty frees the terms themselves."""
    from pulse.llm import toxicity

    rng = random.Random(9)
    bad, good = ["vile", "filthy", "stupid", "awful"], ["kind", "quiet", "young", "clever"]
    rows = []
    for k in range(600):
        toxic = rng.random() < 0.5
        term = "muslims" if rng.random() < (0.85 if toxic else 0.15) else "christians"
        rows.append((k, f"the {rng.choice(bad if toxic and rng.random() < 0.9 else good)} {term} live in town {rng.randrange(30)}", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    text = pa.array(["the quiet muslims live in town 3", "the quiet christians live in town 3"])

    def gap(**options):
        logit = np.log(1 / (1 / toxicity.train(docs, labels, **options).scores(text) - 1))
        return abs(logit[0] - logit[1])

    assert gap() < 0.2 and gap() < 0.2 * gap(fairness=0.0)


def test_texts_without_a_letter_have_no_language(spark):
    from pulse.llm import language

    rows = [(k, f"{a} {b} und der die das", "de") for k, (a, b) in enumerate(zip("abcdefgh", "ijklmnop"))]
    rows += [(k + 20, f"{a} {b} and of the this", "en") for k, (a, b) in enumerate(zip("abcdefgh", "ijklmnop"))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, "²"), (2, "½ 3"), (3, "Ⅷ"), (4, "12 !?"), (5, None), (6, "ª"), (7, "3a")]
    got = language.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in got} == {k: not any(map(str.isalpha, t or "")) for k, t in odd}


# Mixing and the pipeline


def test_mixing_spends_budgets(spark):
    from pulse.llm import mixing

    rng = random.Random(3)
    names = ["a"] * 6000 + ["b"] * 900 + ["c"] * 90 + [None] * 10
    schema = "doc_id long, source string, size long, place string, `pass` string, `of` int, `row` int, block int, left string"
    rows = [(k if k % 50 else None, s, rng.choice([None, 0, *range(5, 60)]), "p", "q", 1, 2, 3, "l") for k, s in enumerate(names)]
    table = spark.createDataFrame(rows, schema).repartition(4)
    mixed = mixing.mix(table, "size", max_repeats=1.7, columns=("slot", "shown", "weight")).cache()
    assert mixed.columns == [*table.columns, "slot", "shown", "weight"]
    assert mixed.select(table.columns).exceptAll(table).count() == mixed.count() - len(rows)  # every row is there, unchanged
    tokens_of = defaultdict(int)
    for row in rows:
        tokens_of[row[1]] += row[2] or 0
    total = sum(tokens_of.values())
    # A plain bisection of the exponent: as flat as the limit of repetitions allows.
    share = {s: n / total for s, n in tokens_of.items()}
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (max(share.values()) / min(share.values())) ** (1 - middle) <= 1.7 else (middle, high)
    z = sum(p**high for p in share.values())
    weight = {s: p**high / z for s, p in share.items()}
    repeats = {s: weight[s] / share[s] * max(p ** (1 - high) for p in share.values()) * z for s in share}
    got = {r.source: r for r in mixed.groupBy("source").agg(F.sum("size").alias("n"), F.max("weight").alias("w")).collect()}
    for s in share:
        assert got[s].w == pytest.approx(weight[s], rel=1e-3)
        assert 0 <= repeats[s] * tokens_of[s] - got[s].n < 80 + 1e-3 * tokens_of[s], s  # the budget, but for the row that would pass it
    slots = [r.source for r in mixed.orderBy("slot").limit(1000).collect()]
    assert abs(slots.count("a") / 1000 - sum(r.source == "a" for r in mixed.collect()) / mixed.count()) < 0.06
    with pytest.raises(ValueError):
        mixing.mix(table, "size", columns=("row",))
    again = mixing.mix(table, "size", max_repeats=1.7, columns=("slot", "shown", "weight"))
    assert again.exceptAll(mixed).count() == 0  # the same on every run


def test_mixing_query_counts_tokens(spark, folder):
    sizes = {r.doc_id: r.tokens for r in llm.QUERIES["op3_temperature_mixing"](spark, folder).collect()}
    cache = tokens.WordIds.shared("word_bpe_49k.json").library
    for r in llm.documents(spark, folder).collect():
        assert sizes[r.doc_id] == len(cache.encode(r.text or "", add_special_tokens=False)) + 1


CLASH = "doc_id long, text string, lang string, source string, n_chars long, id string, `_tokens` string, `_slot` int, sketch int"


def test_stages_judge_rows(spark, folder):
    import corpus_pipeline

    docs = llm.documents(spark, folder)
    good = [r.text for r in docs.filter("lang = 'en' and n_chars > 900").limit(3).collect()]
    long = " ".join(f"{w}{k}" for k in range(800) for w in good[0].split()[:30])
    texts = [(1, good[0]), (1, good[0]), (None, good[1]), (None, good[1]), (2, good[1]), (1, "²½ ||| 12"), (None, "!!! 1 2 3"), (None, None), (7, ""), (8, long), (None, good[2])]
    rows = spark.createDataFrame([(d, t, "en", "s", 1, "x", "y", 5, 6) for d, t in texts], CLASH).repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in list(stages.items())[:4]:
        assert stage(spark, rows.filter("false"), folder).count() == 0, name
        assert stage(spark, rows, folder).columns == rows.columns, name
    languages = sorted((r.doc_id or 0, r.text) for r in stages["language identification"](spark, rows, folder).collect())
    assert languages == sorted((d or 0, t) for d, t in texts if t and any(map(str.isalpha, t)))
    once = [(r.doc_id, r.text) for r in stages["near-duplicate removal"](spark, rows, folder).collect()]
    expected = [(1, good[0]), (2, good[1]), (1, "²½ ||| 12"), (None, "!!! 1 2 3"), (None, None), (7, ""), (8, long), (None, good[2])]
    assert sorted(map(str, once)) == sorted(map(str, expected))
    quality = stages["quality classifier"](spark, rows, folder).collect()
    assert [r.text for r in quality].count(good[1]) in (0, 3)  # one verdict for a text, whatever the ids
    mixed = stages["source mixing"](spark, rows, folder)
    assert rows.exceptAll(mixed).count() == 0
    packed = stages["packing"](spark, rows, folder)
    assert packed.filter("start = 0").count() == len(texts) and stages["packing"](spark, rows.filter("false"), folder).count() == 0


def test_fingerprints_estimate_counts_and_containment(spark):
    """Against exact sets: exact below k shingles, else within a few standard errors; parts merge to the whole."""
    from pulse.llm import fingerprints

    rng = random.Random(12)
    words = [f"w{k}" for k in range(6000)]
    texts = [" ".join(words[a : a + n]) for a, n in [(0, 0), (0, 3), (0, 30), (10, 60), (0, 3000), (500, 2500), (0, 6000), (3000, 3000)]]
    texts += [" ".join(rng.choices(words[:50], k=400))]
    exact = [{tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if (own := t.split()) else set() for t in texts]
    rows = spark.createDataFrame([*enumerate(texts)], "id int, text string").withColumn("sketch", fingerprints.sketch(F.col("text"), 256))
    pairs = rows.toDF("a", "text_a", "sketch_a").crossJoin(rows.toDF("b", "text_b", "sketch_b"))
    counted = fingerprints.distinct_shingles(F.col("sketch_a"), 256).alias("n")
    within = fingerprints.containment(F.col("sketch_a"), F.col("sketch_b"), 256).alias("within")
    for r in pairs.select("a", "b", counted, within).collect():
        a, b = exact[r.a], exact[r.b]
        assert r.n == len(a) if len(a) < 256 else abs(r.n / len(a) - 1) < 0.3
        share = len(a & b) / len(a) if a else 1.0
        if len(a | b) < 256:
            assert abs(r.within - share) < 1e-9
        elif 256 * len(a) / len(a | b) >= 60:  # else the sketch of both holds too few of the first one's values to tell
            assert abs(r.within - share) < 0.3, (r, share)
    parts = spark.createDataFrame([(1, " ".join(words[k * 40 : k * 40 + 44])) for k in range(20)], "id int, text string")
    parts = parts.withColumn("sketch", fingerprints.sketch(F.col("text"), 256))
    whole = spark.createDataFrame([(" ".join(words[:804]),)], "text string").select(fingerprints.sketch(F.col("text"), 256).alias("s"))
    assert fingerprints.merge_sketches(parts, "id", k=256).first().sketch == whole.first().s


def test_word_tables_take_short_runs():
    """The tables of n-grams of a run take many times its bytes, so a run holds a quarter of a million of them at most."""
    from pulse.llm.learning import word_tables

    texts = pa.array([f"word{k} " * 100 for k in range(1200)])
    runs = list(word_tables(texts))
    assert sum(len(ends) - 1 for _, _, ends in runs) == len(texts)
    assert max(ends[-1] for _, _, ends in runs) <= (1 << 18) // 6 + 1200
