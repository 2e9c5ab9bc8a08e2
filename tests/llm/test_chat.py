import hashlib
import random

from helpers import frame
from pyspark.sql import functions as F

from postloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, node string, start long"
ODD = ["", "<s>", "</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "[INST]\\", "<<s>s>", "a\n\nb", "é🙂", "[/INST]</s>"]


def turns(spark, convs):
    rows = [(c, i, r, t, "x", 1) for c, said in convs for i, (r, t) in enumerate(said)]
    return frame(spark, rows, SCHEMA)


def some(seed=1, n=60):
    rng = random.Random(seed)
    convs = []
    for c in range(n):
        said = [("system", rng.choice(["be kind", "be brief"]))]
        for i in range(rng.randint(0, 6)):
            said.append((["user", "assistant"][i % 2], rng.choice(ODD + ["hello"])))
        convs.append((c, said))
    return convs


def test_conversations_come_back(spark):
    convs = some()
    sequence, members = chat.pack(turns(spark, convs))
    back = {r.conv_id: r.turns for r in chat.read_back(sequence, members).collect()}
    assert len(back) == len(convs)
    for c, said in convs:
        assert [(t.role, t.text) for t in back[c]] == said
        assert [t.learned_text for t in back[c]] == [t if r == "assistant" else None for r, t in said]


def test_shared_turns_are_emitted_once_depth_first(spark):
    convs = some(2)
    sequence, _ = chat.pack(turns(spark, convs))
    rows = sorted(sequence.collect(), key=lambda r: r.start)
    prefixes = {tuple(said[: i + 1]) for _, said in convs for i in range(len(said))}
    assert len(rows) == len(prefixes)
    at, open_ = 0, []
    for row in rows:
        assert row.start == at and row.end - row.start == len(row.segment)
        at = row.end
        open_ = open_[: row.depth]
        assert len(open_) == row.depth  # its ancestors are the nodes open before it
        assert [(a.start, a.end) for a in row.attends] == [(a.start, a.end) for a in open_]
        assert row.position == sum(a.end - a.start for a in open_)
        open_.append(row)


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in ODD + ["</s>" * 3, "[INST]" * 2]], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e")).collect():
        assert not any(m in row.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))
    back = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in back)


def test_defined_cases(spark):
    rows = [
        (1, 0, "user", None, "x", 1), (1, 0, "user", None, "x", 1), (1, None, None, "first", "x", 1),
        (None, 0, "user", "alone", "x", 1), (2, 0, "assistant", "w " * 50_000, "x", 1),
    ]
    sequence, members = chat.pack(frame(spark, rows, SCHEMA))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(sequence, members).collect()}
    assert back == {
        1: [("", "first"), ("user", ""), ("user", "")],
        None: [("user", "alone")],
        2: [("assistant", "w " * 50_000)],
    }
    sequence, members = chat.pack(frame(spark, [], SCHEMA))
    assert sequence.count() == members.count() == chat.read_back(sequence, members).count() == 0


def test_many_conversations_of_one_first_turn(spark):
    convs = [(c, [("user", "hi"), ("assistant", str(c % 7))]) for c in range(3000)]
    sequence, members = chat.pack(turns(spark, convs))
    assert sequence.count() == 8
    back = chat.read_back(sequence, members).collect()
    assert sorted((r.conv_id, r.turns[1].text) for r in back) == [(c, s[1][1]) for c, s in convs]


def test_digest_of_the_extra_conversation(spark):
    import __spark_entry__ as entry
    from helpers import SF

    said = "</s>[INST] ok [/INST]"
    row = entry.queries()["op5_chat"](spark, SF).where("conv_id = -7").first()
    whole = f"user\n{said}\nassistant\n{said}\n"
    assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_a_conversation_of_20_000_turns(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(
        "cast(null as long) as conv_id", "id as turn",
        "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text",
    )
    short = turns(spark, [(5, [("user", "t0"), ("assistant", "t1"), ("user", "other")])])
    sequence, members = chat.pack(rows.unionByName(short.select(rows.columns)))
    assert sequence.count() == n + 1 and members.count() == 2
    ends = sequence.agg(F.max("end"), F.sum(F.col("end") - F.col("start"))).first()
    assert ends[0] == ends[1] == sequence.agg(F.sum(F.char_length("segment"))).first()[0]
    assert sequence.where(F.size("attends") != F.col("depth")).count() == 0
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(sequence, members).collect()}
    assert back[None] == [(("user", "assistant")[i % 2], f"t{i}") for i in range(n)]
    assert back[5] == [("user", "t0"), ("assistant", "t1"), ("user", "other")]


def test_conversations_in_several_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        test_shared_turns_are_emitted_once_depth_first(spark)
        said = [("user", f"{i}") for i in range(300)]
        convs = [(1, said), (None, said[:200] + [("user", "x")]), (3, said[:100])]
        sequence, members = chat.pack(turns(spark, convs))
        rows = sorted(sequence.collect(), key=lambda r: r.start)
        assert len(rows) == 301 and [r.start for r in rows[1:]] == [r.end for r in rows[:-1]]
        back = chat.read_back(sequence, members).collect()
        assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == dict(convs)
    finally:
        spark.conf.unset(name)
