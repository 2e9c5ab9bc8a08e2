import random

import numpy as np
from helpers import SF, documents, frame

from postloom.llm import toxicity

BAD = ["grumble", "snarkface", "vilething"]


def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghi") for _ in range(5)) for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 8) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "x", "ing"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def labels(spark, rows):
    return frame(spark, rows, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    texts, toxic = labelled(spark)
    known = labels(spark, [(i, 1, t) for i, t in enumerate(toxic[:300])] + [(5, 1, None), (None, 1, 1), (7, 1, 0)])
    docs = documents(spark, texts)
    model = toxicity.fit(docs, known)
    assert len(model.features) <= toxicity.Settings().features and model.thresholds == sorted(model.thresholds)
    found = {r.doc_id: r.severity for r in toxicity.severity(docs, model).collect()}
    assert [found[i].toxic for i in range(len(texts))] == [t == 1 for t in toxic]
    # More toxic words, greater expected severity; never beyond the greatest grade.
    more = toxicity.severity(documents(spark, ["aaa", "aaa grumble", "aaa" + " grumble" * 9]), model).collect()
    scores = [r.severity.expected for r in sorted(more, key=lambda r: r.doc_id)]
    assert scores == sorted(scores) and 0 <= scores[0] < 0.5 < scores[2] <= 3
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, t in enumerate(toxic) if not t}


def test_defined_cases(spark):
    texts, toxic = labelled(spark, 120)
    docs = documents(spark, texts)
    model = toxicity.fit(docs, labels(spark, [(i, 1, t) for i, t in enumerate(toxic)]))
    odd = documents(spark, [None, "", "clean", "clean", "grumble " * 60_000], [1, 2, 3, 3, None])
    found = toxicity.severity(odd, model).collect()
    assert [r.severity.toxic for r in found] == [False, False, False, False, True]
    assert toxicity.drop_toxic(odd.limit(0), model).count() == 0
    for rows in ([], [(1, 1, 0)], [(0, 1, 1)], [(10_000, 1, 1)]):
        empty = toxicity.fit(docs, labels(spark, rows))
        assert empty.features == []
        scored = toxicity.severity(odd, empty).collect()
        assert [tuple(r.severity) for r in scored] == [(0.0, False)] * 5


def test_the_fit_looks_at_a_bounded_sample_only(spark):
    texts, toxic = labelled(spark)
    known = labels(spark, [(i, 1, t) for i, t in enumerate(toxic)])
    small = toxicity.Settings(per_grade=40, features=5)
    model = toxicity.fit(documents(spark, texts), known, settings=small)
    assert 0 < len(model.features) <= 5


def test_gradient_is_that_of_the_likelihood():
    """Where features say nothing, the thresholds give the grades' shares back."""
    grades = np.array([0] * 50 + [1] * 30 + [2] * 15 + [3] * 5)
    _, cut = toxicity.fit_ordinal(np.zeros((100, 1)), grades, toxicity.Settings(steps=500))
    assert np.allclose(1 / (1 + np.exp(cut)), [0.5, 0.2, 0.05], atol=0.01)


def test_ordered_grades_are_learned_from(spark):
    rng = np.random.default_rng(1)
    grades = np.arange(400) % 4
    x = np.stack([grades + rng.normal(0, 0.3, 400), rng.normal(0, 1, 400)], 1)
    weights, cut = toxicity.fit_ordinal(x, grades, toxicity.Settings(steps=500))
    above = 1 / (1 + np.exp(-((x @ weights)[:, None] - cut)))
    assert np.corrcoef(above.sum(1), grades)[0, 1] > 0.9 and abs(weights[0]) > 5 * abs(weights[1])


def test_labels_of_the_given_documents(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op4_toxicity"](spark, SF.replace("0.001", "0.01")).collect()
    known = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()
    toxic = {r.doc_id: r.toxic for r in rows}
    clean = [toxic[r.doc_id] for r in known if r.toxic == 0]
    assert len(rows) == 1000 and sum(clean) == 0


def test_columns_that_differ_by_case_only_stay(spark):
    texts, toxic = labelled(spark, 120)
    docs = documents(spark, texts).withColumnRenamed("node", "_SEVERITY")
    model = toxicity.fit(docs, labels(spark, [(i, 1, t) for i, t in enumerate(toxic)]))
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
