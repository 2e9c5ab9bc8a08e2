import random

import numpy as np
from helpers import documents

from postloom.llm import licenses
from postloom.llm.license_texts import NOTICES


def found(spark, texts, **options):
    return licenses.scan(documents(spark, texts), **options).collect()


def test_notices_are_found_with_their_spans(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(i) for i in range(n))
    texts = [f"{filler(30)} é\n{text.upper()} {filler(30)}" for _, text in NOTICES]
    rows = {r.doc_id: r for r in found(spark, texts)}
    assert len(rows) == len(NOTICES)
    for i, (name, text) in enumerate(NOTICES):
        row = rows[i]
        assert (row.license, row.template, row.coverage) == (name, i, 1.0)
        span = texts[i][row.start : row.end]
        assert text.upper().startswith(span) and len(text) - len(span) <= 2


def test_changed_notices_and_strangers(spark):
    apache = NOTICES[4][1].split()
    changed = apache[:10] + ["new", "words"] + apache[10:30] + apache[31:50] + ["other"] + apache[51:]
    texts = [" ".join(changed), " ".join(apache[:40]), "the license of the software", None, "", "version 3 only"]
    rows = found(spark, texts)
    whole = [r for r in rows if r.doc_id == 0]
    assert [(r.license, r.template) for r in whole] == [("Apache-2.0", 4)]
    assert 0.85 < whole[0].coverage < 1 and whole[0].first_word == 0
    assert {r.doc_id for r in rows} == {0, 1}
    assert [r.template for r in rows if r.doc_id == 1] == [3]  # the short notice that it begins with


def test_defined_cases(spark):
    line = "Released under the MIT License."
    texts = [line, line, f"{line}\n" * 300, "x " * 100_000 + line]
    docs = documents(spark, texts, [1, 1, 2, None])
    rows = licenses.scan(docs).collect()
    count = lambda i: sum(r.doc_id == i for r in rows)
    assert (count(1), count(2), count(None)) == (2, 300, 1)
    spans = sorted((r.first_word, r.end_word) for r in rows if r.doc_id == 2)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates=[]).count() == 0
    assert licenses.scan(docs, templates=[("x", ""), ("y", ".")]).count() == 0


def test_a_shared_run_always_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 3).astype(np.uint64)  # gram + window - 1 words give 3 hashes
        rows = [
            np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), shared, rng.integers(0, 2**63, m).astype(np.uint64)])
            for n, m in ((5, 2), (0, 9))
        ]
        prints = [
            set(v[licenses.winnow(v, np.array([0, len(v)]), 3)[1]].tolist()) for v in rows
        ]
        assert prints[0] & prints[1] & set(shared.tolist())


def test_alignment_equals_a_plain_one():
    rng = random.Random(3)
    for _ in range(100):
        template = [rng.randrange(6) for _ in range(12)]
        text = [rng.randrange(6) for _ in range(5)] + template[:4] + [9] + template[4:8] + template[9:]
        got, first, end = licenses.align(np.array(template), np.array(text), 5, 8)
        assert got >= 11 - 1 and first <= 5 and end >= len(text) - 1


def test_edited_and_neighbouring_short_notices(spark):
    want = {
        "Released under the MIT Licence.": "MIT",
        "Released under an MIT License.": "MIT",
        "Licensed under the Apache Licence, Version 2.0.": "Apache-2.0",
        "Licensed under the Apache License 2.0.": "Apache-2.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "Released under the MIT No Attribution License.": None,
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License v3.": "GPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "Licensed under CC BY 3.0.": "CC-BY-3.0",
        "Licensed under CC BY, version 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    rng = random.Random(4)
    filler = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30)))
    lines = [line for line in want for _ in range(40)]
    rows = found(spark, [f"{filler()} {line} {filler()}" for line in lines])
    got = {i: set() for i in range(len(lines))}
    for r in rows:
        got[r.doc_id].add(r.license)
    wrong = {(lines[i], *v) for i, v in got.items() if v != ({want[lines[i]]} - {None})}
    assert not wrong
    long = NOTICES[6][1].replace("GNU General", "GNU Lesser General")
    assert not found(spark, [long]) and len(found(spark, [NOTICES[6][1]])) == 1
