"""What a task holds at once: parts of Arrow batches by bytes of text, and batches of bounded size."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from pulse.llm import neardup, shingles, tokens
from pulse.session import narrow_batches


def test_text_batches_keep_all_rows():
    texts = ["a" * 600, None, "b" * 600, "", "c" * 5000, "d", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(shingles.text_batches([batch, batch.slice(0, 0)], 1000))
    assert [part.num_rows for part in parts] == [2, 2, 1, 2]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_batches_are_narrow(spark):
    """Texts of 10 KB would make one batch of 10 MB."""
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    def largest():
        return max(row.size for row in docs.mapInArrow(sizes, "size long").collect())

    assert largest() > 8 << 20
    with narrow_batches(spark, 1 << 20):
        assert largest() < 2 << 20


def test_near_duplicates_write_in_narrow_batches(spark, monkeypatch):
    inside = []
    plain = neardup.narrow_batches
    monkeypatch.setattr(neardup, "narrow_batches", lambda session: inside.append(session) or plain(session))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert inside


def test_narrow_batches_are_undone(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), narrow_batches(spark):
        assert int(spark.conf.get(name)) < 64 << 20
        raise ZeroDivisionError
    assert spark.conf.get(name) == was


def test_lists_reject_large_sets_of_middle_likeness(spark):
    """Sets of 300 to 900 values in one list, alike by 0.6 to 0.9: only pairs that are alike leave the task."""
    rng, texts = random.Random(5), []
    for base in range(4):
        words = [f"{base}x{i}" for i in range(rng.randrange(300, 900))]
        texts += [" ".join(w if rng.random() > share else f"{w}y{k}" for w in words) for k, share in enumerate([0.02, 0.08, 0.12, 0.13] * 3)]
    sets = [set(t.split()) for t in texts]
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    pairs = sorted(p for p, share in likeness.items() if share >= 0.8)
    assert pairs and sum(0.6 < share < 0.8 for share in likeness.values()) > 100
    assert links_of(spark, texts, [len(s) for s in sets]) == pairs


def test_very_large_sets_are_rejected_by_estimate(spark):
    """Sets of 4,000 values, alike by about 0.63 and by 0.82: the first stay, the second go on to be compared whole."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join(w + "y" * (i % 9 < 2) for i, w in enumerate(words)), " ".join(w + "z" * (i % 10 < 1) for i, w in enumerate(words))]
    assert links_of(spark, texts, [4000] * 3) == [(0, 2)]


def links_of(spark, texts, sizes):
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    members = spark.createDataFrame([(7, i, i, n) for i, n in enumerate(sizes)], "key long, id long, component long, n long")
    found = neardup.links_in_lists(neardup.sided(members), neardup.wide_sketches(table, members, 1), 0.8)
    return sorted((r.a, r.b) for r in found.collect())


def test_pipeline_stages_work_in_narrow_batches(spark, monkeypatch):
    """The 10 MB of texts that a stage reads come in parts."""
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    monkeypatch.setattr(corpus_pipeline, "documents", lambda session, folder: docs)
    stages = [("sizes", lambda session, rows, folder: rows.mapInArrow(sizes, "size long")), ("last", lambda session, rows, folder: rows)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert max(row.size for row in corpus_pipeline.run(spark, "").collect()) < 8 << 20


def test_near_duplicate_tasks_drop_the_words_that_others_left():
    """A worker that encoded texts does not hold their words beside the sets of near-duplicate removal."""

    class Docs:
        def mapInArrow(self, work, schema):
            return work

    tokens.token_ids(pa.array(["some words of a text"]), "word_bpe_49k.json", 1)
    assert tokens._cached
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    rows = [row for out in neardup.signatures(Docs(), 2, 0.8)([batch]) for row in out.to_pylist()]
    assert [row["n"] for row in rows] == [4]
    assert not tokens._cached
