import random

import numpy as np
import pytest
from helpers import SF, components, documents

from postloom.llm import minhash
from postloom.llm.graph import components as connected
from postloom.operators import joins
from postloom.sources.scratch import Workspace


def words(rng, n):
    return ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n)]


def changed(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = "".join(rng.choice("hijkl") for _ in range(5))
    return out


def family_texts(seed=5):
    """Copies, chains of copies at the edge of the threshold, and strangers."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = words(rng, 120)
        texts += [" ".join(base)] * 3
        for n in (1, 2, 3, 4, 5, 6):
            texts += [" ".join(changed(rng, base, n)) for _ in range(6)]
    texts += [" ".join(words(rng, 80)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("block", [3, 128])
def test_classes_equal_brute_force(spark, k, block):
    texts = family_texts(k)
    found = minhash.near_duplicates(
        documents(spark, texts), settings=minhash.Settings(shingle=k, block=block)
    ).collect()
    assert {r.doc_id: r.component_id for r in found} == components(range(len(texts)), texts, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_defined_cases(spark):
    same = "one two three four five six seven"
    texts = [None, "", " \t\n", None, "short", "Short", same, same, same, same.upper(), "x " * 40_000]
    ids = [1, 2, 3, 4, 5, 6, 7, 7, None, 9, 10]
    found = minhash.near_duplicates(documents(spark, texts, ids), settings=minhash.Settings(shingle=4))
    rows = sorted(map(tuple, found.collect()), key=str)
    want = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True),
        (6, 1, 5, False), (7, 4, 7, True), (7, 4, 7, True), (None, 4, 7, False), (9, 4, 7, False),
        (10, 1, 10, True),
    ]
    assert rows == sorted(want, key=str)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    alone = minhash.near_duplicates(documents(spark, ["a b c d e f"], [None])).first()
    assert alone.component_id is None and alone.kept


def test_one_document_of_each_group_stays(spark):
    texts = family_texts(9)
    docs = documents(spark, texts)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(components(range(len(texts)), texts, 5).values())
    twice = minhash.drop_near_duplicates(documents(spark, ["b b b b b b", "a", None], [1, 1, 2]))
    assert sorted((r.doc_id, r.text or "") for r in twice.collect()) == [(1, "a"), (2, "")]


def test_repeated_and_null_ids_neither_lose_nor_spare_rows(spark):
    import corpus_pipeline

    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "p q r s t u v")
    rows = [
        (1, "b b b b b b"), (1, "a"), (2, None), (2, None), (5, a), (5, b), (3, a.upper()),
        (None, a), (None, c), (None, c), (None, None), (7, b + " "), (8, "x y"), (8, "x y"),
    ]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    docs = docs.withColumnRenamed("node", "_place").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    kept = left.collect()
    want = [
        (1, "b b b b b b"), (1, "a"), (2, None), (2, None), (5, b), (3, a.upper()), (None, c),
        (None, None), (8, "x y"),
    ]
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted(want, key=str)
    assert all(r.lang == "en" and r.source == "s" and r.n_chars == 0 for r in kept)
    texts = family_texts(11)
    left = minhash.drop_near_duplicate_rows(documents(spark, texts).repartition(5))
    assert {r.doc_id for r in left.collect()} == set(components(range(len(texts)), texts, 5).values())
    assert minhash.drop_near_duplicate_rows(documents(spark, [])).count() == 0
    clash = documents(spark, ["a b", "a b", "c"]).withColumnsRenamed(
        {"_text": "_drop", "_row": "_MANY", "node": "_Place", "source": "_kept"}
    )
    for drop in (minhash.drop_near_duplicate_rows, minhash.drop_near_duplicates):
        left = drop(clash)
        assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect()) == [0, 2]


def test_posterior_bound_is_monotone_and_spares_the_similar():
    settings = minhash.Settings()
    least = minhash.least_matches(settings)
    assert (np.diff(least) >= 0).all() and least[settings.hashes] <= 0.8 * settings.hashes
    rng = np.random.default_rng(0)
    left = np.zeros((20_000, settings.hashes), np.uint32)
    right = (rng.random(left.shape) > 0.8).astype(np.uint32)
    assert len(minhash.plausible(left, right, settings, least)) > 19_990
    assert len(minhash.plausible(left, 1 - right, settings, least)) == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, i) for i in range(1001, 1500)]
    links = spark.createDataFrame(chain + star + [(5, 5), (None, 7)], "a long, b long")
    with Workspace(spark) as work:
        rows = connected(links, work).collect()
    found = {r.node: r.component for r in rows}
    assert len(set(found[i] for i in range(401))) == 1
    assert len(set(found[i] for i in range(1000, 1500))) == 1
    assert found[0] != found[1000] and len(found) == 901


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = components([r.doc_id for r in rows], [r.text for r in rows], 4)
    found = minhash.near_duplicates(docs, settings=minhash.Settings(shingle=4)).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_long_ids_are_not_sent_around(spark, monkeypatch):
    ids = spark.range(50).selectExpr("repeat(cast(id as string), 1000) as id")
    assert "ResolvedHint" in minhash._sent(ids)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(minhash, "fits", lambda table, rows: joins.fits(table, rows, 1 << 10))
    assert "ResolvedHint" not in minhash._sent(ids)._jdf.queryExecution().analyzed().toString()
    texts = family_texts(7)
    names = [f"{i:03d}" * 40 for i in range(len(texts))]
    docs = documents(spark, texts).join(
        spark.createDataFrame(list(enumerate(names)), "doc_id long, name string"), "doc_id"
    )
    found = {r.name: r.component_id for r in minhash.near_duplicates(docs, "name").collect()}
    assert found == components(names, texts, 5)
