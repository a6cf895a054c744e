"""Held-out accuracy, the risk's correction and defined cases of the toxicity scores."""

import random
import zlib

import numpy as np
from llm_data import docs_table, edge_rows, words

from wattloom.llm import toxicity


def labelled(n=1200):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        text, toxic = words(rng.randrange(20, 200), k, 800), int(k % 5 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "Moron,", "scum!"])
        rows.append((k, " ".join(text)))
        if k % 2 == 0:
            labels.append((k, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_split(spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_table(spark, rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in kept) >= 0.97 * len(kept)


def test_held_out_labels_are_never_used(spark):
    rows, labels = labelled(400)
    docs = docs_table(spark, rows)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    one, other = (
        {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
        for x in (labels, flipped)
    )
    assert one == other


def test_corrected_risk_separates_positive_from_the_rest_of_unlabelled():
    rng = np.random.default_rng(4)
    mark = 7

    def document(toxic):
        return np.unique(np.append(rng.integers(100, 400, 30), [mark] if toxic else []).astype(np.uint32))

    sample = [(True, document(True)) for _ in range(150)] + [(False, document(k % 4 == 0)) for k in range(600)]
    model = toxicity.fit(sample, 0.25)
    weight = dict(zip(model.features.tolist(), model.weights))
    assert weight[7] > 3 * max([0.1, *(abs(w) for k, w in weight.items() if k != 7)])


def test_defined_cases(spark):
    rows, labels = labelled(400)
    schema = "doc_id long, quality int, toxic int"
    extra = edge_rows()
    moved = [(None if d is None else d + 10_000, t) for d, t in extra]
    got = toxicity.toxicity(docs_table(spark, rows + moved), spark.createDataFrame(labels + [(None, None, None)], schema)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id in (10_001, 10_002, 10_003)} == {0}
    no_labels = toxicity.toxicity(docs_table(spark, rows), spark.createDataFrame([], schema)).collect()
    assert {r.score for r in no_labels} == {0.0}
    assert toxicity.toxicity(docs_table(spark, []), spark.createDataFrame([], schema)).count() == 0
