import random
import re

import pytest
from helpers import UPPER, documents, frame

from postloom.llm import decontaminate
from postloom.llm.decontaminate import build_automaton, clean_text, find_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(len(v), window)
        if not k:
            continue
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                names.add(name)
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_hits_equal_brute_force(seed, letters):
    import pyarrow as pa

    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    items = [(f"i{i}", make(rng.choice([2, 4, 30]))) for i in range(12)] + [("x", "A-b, a")]
    texts = [make(60) for _ in range(60)]
    texts += [make(10) + " " + rng.choice(items)[1] + ". " + make(10) for _ in range(60)]
    machine = build_automaton(items, 5)
    for text, (n, spans, names, _) in zip(texts, find_hits(pa.array(texts), machine)):
        got = (n, sum(b - a for a, b in spans), sorted(names))
        assert got == brute(text, items, 5), text


def benchmark(spark, rows):
    return frame(spark, rows, "item_id long, text string")


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "only three words"), (3, None), (4, " .,"), (None, "q r s"), (12, LONG)]


def test_defined_cases(spark, monkeypatch):
    part = " ".join(f"w{i}" for i in range(5, 15))
    texts = [None, "", f"Zero {part.upper()} end", "ONLY three, words!", part.rsplit(" ", 1)[0], f"{LONG} {LONG}", "q r s"]
    texts.append("word " * 50_000 + LONG)
    docs = documents(spark, texts)
    items = [("" if i is None else str(i), t) for i, t in ITEMS]
    for size in (4 << 20, 60):  # one automaton, then several in turn
        monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", size)
        found = decontaminate.contamination(docs, benchmark(spark, ITEMS)).collect()
        for row in found:
            n, hit, names = brute(texts[row.doc_id], items)
            assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (n, hit, names, hit > 0)
            assert row.n_items == len(names)
    assert decontaminate.contamination(docs.limit(0), benchmark(spark, ITEMS)).count() == 0
    none = decontaminate.contamination(docs, benchmark(spark, [])).collect()
    assert not any(r.contaminated for r in none) and none[2].n_words == 12


def test_spans_are_cut_and_nothing_else(spark):
    tail = " and then more of the own text that is quite long enough to stay here for good"
    texts = [None, "", "clean text", f"Start: {LONG}; {tail * 3}", LONG, f"a {LONG[:40]} {LONG}{tail * 3}"]
    docs = documents(spark, texts)
    left = decontaminate.decontaminate(docs, benchmark(spark, ITEMS))
    assert left.columns == docs.columns
    rows = {r.doc_id: r.text for r in left.collect()}
    assert 4 not in rows  # all of it is benchmark
    assert rows[0] is None and rows[1] == "" and rows[2] == "clean text"
    assert rows[3] == f"Start: ; {tail * 3}"
    items = [("" if i is None else str(i), t) for i, t in ITEMS]
    for text in rows.values():
        assert brute(text, items)[1] == 0
    sized = decontaminate.decontaminate(docs, benchmark(spark, ITEMS), length="n_chars").collect()
    assert {r.doc_id: r.n_chars for r in sized} == {i: len(t) if t != texts[i] else 0 for i, t in rows.items()}


def test_what_closes_up_to_a_passage_goes_too():
    machine = build_automaton([("a", LONG), ("b", "middle part")], 10)
    first, second = LONG[: LONG.index(" w12")], LONG[LONG.index("w12") :]
    text, n, cut = clean_text(f"{first} middle part {second} rest", [machine])
    assert "w12" not in text and text.strip() == "rest" and n == 28 and cut == 27


def test_a_benchmark_of_many_parts_is_built_in_tasks_and_met_in_passes(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("abcdefghijkl") + str(rng.randrange(40)) for _ in range(n))
    items = [(i, make(rng.choice([4, 30, 400]))) for i in range(30)]
    texts = [None, "", make(80)]
    for _, item in items:
        w = item.split()
        at = rng.randrange(len(w))
        texts.append(f"{make(60)} {' '.join(w[at : at + rng.choice([3, 12, 25])])}; {make(20)}")
        texts.append(f"{make(400)} {' '.join(w[:6])} {items[0][1]} {' '.join(w[6:12])} {make(9)}")
    docs = documents(spark, texts).withColumnRenamed("node", "_report").repartition(3)
    bench = benchmark(spark, items + items[:3])
    whole = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    left = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, length="n_chars").collect()}
    names = [(str(i), t) for i, t in items]
    for i, row in whole.items():
        assert (row.n_words, row.n_hit, row["items"]) == brute(texts[i], names), i
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 1600)
    assert any(len(t) > 1600 // 16 for _, t in items)  # items in pieces
    parts = []
    built = decontaminate.automata

    def counted(*args):
        machines, n = built(*args)
        parts.append(n)
        return machines, n

    monkeypatch.setattr(decontaminate, "automata", counted)
    for row in decontaminate.contamination(docs, bench).collect():
        assert row.asDict() | {"longest": 0} == whole[row.doc_id].asDict() | {"longest": 0}
    cut = decontaminate.decontaminate(docs, bench, length="n_chars")
    assert cut.columns == docs.columns
    assert {r.doc_id: r for r in cut.collect()} == left
    assert min(parts) > decontaminate.PASS_PARTS


def test_the_driver_takes_one_pass_of_automata_at_a_time(spark, monkeypatch):
    from postloom.sources.scratch import Workspace

    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 1600)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(60)]
    with Workspace(spark) as work:
        machines, parts = decontaminate.automata(benchmark(spark, items), "item_id", "text", 10, work)
        held = [len(sent.value) for sent in decontaminate.passes(machines, parts)]
    assert parts > decontaminate.PASS_PARTS and max(held) <= decontaminate.PASS_PARTS
    assert len(held) == -(-parts // decontaminate.PASS_PARTS)
