from postloom.functions.html import outline, parse_html
from postloom.functions.select import (
    Selector,
    below,
    find,
    find_all,
    text_fused,
    text_inline,
    text_joined,
    zip_truncate,
)
from pyspark.sql import functions as F


def parsed(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return df.select("id", parse_html("html").alias("page"))


def texts(spark, html, selector, text):
    shown = F.transform(find_all("page.nodes", selector), lambda n: text("page.texts", n))
    return parsed(spark, html).select(shown.alias("t")).first()["t"]


def tags(html):
    return [(n[2], n[0], n[1]) for n in outline(html)[1]]


def test_an_end_tag_closes_the_nearest_open_match():
    assert tags("<div><b>x<i>y</div>z") == [("div", 0, 2), ("b", 1, 2), ("i", 2, 2)]


def test_unmatched_end_tags_are_ignored():
    assert tags("</p><div></b>x</div>") == [("div", 0, 0)]


def test_void_elements_never_stay_open():
    assert tags("<p>a<br>b<img>c</p><i></i>") == [
        ("p", 0, 2), ("br", 1, 1), ("img", 2, 2), ("i", 3, 3),
    ]


def test_a_paragraph_does_not_close_a_paragraph(spark):
    assert texts(spark, "<p><b>x<br><p>y</p>", Selector(tag="p"), text_joined) == ["x\ny", "y"]


def test_self_closing_element_is_closed():
    assert tags("<div/><i>x</i>") == [("div", 0, 0), ("i", 1, 1)]


def test_script_style_and_comments_are_not_text(spark):
    html = '<div>a<script>var t="</p><i>";</script><style>p{}</style><!-- no -->b</div>'
    assert texts(spark, html, Selector(tag="div"), text_joined) == ["a\nb"]


def test_entities(spark):
    html = "<p>a &amp; b&nbsp;&#65;&#x42; &copy; &bogus;</p>"
    assert texts(spark, html, Selector(tag="p"), text_joined) == ["a & b\xa0AB © &bogus"]


def test_no_break_space_is_stripped(spark):
    html = "<p>\xa0 x y  \xa0</p>"
    assert texts(spark, html, Selector(tag="p"), text_joined) == ["x y"]


def test_joined_and_fused_and_inline(spark):
    html = "<p><b>a</b> c<br>d</p>"
    assert texts(spark, html, Selector(tag="p"), text_joined) == ["a\nc\nd"]
    assert texts(spark, html, Selector(tag="p"), text_fused) == ["acd"]
    assert texts(spark, "<p> a\n <b>b</b> c</p>", Selector(tag="p"), text_inline) == ["a b c"]


def test_class_word_and_class_substring(spark):
    html = '<p class="post_message_x">1</p><p class="a\tpost_message b">2</p>'
    assert texts(spark, html, Selector(cls="post_message"), text_joined) == ["2"]
    assert texts(spark, html, Selector(cls_contains="post_message"), text_joined) == ["1", "2"]


def test_id_prefix_and_href(spark):
    html = '<a id="thread_title_1" href="/x">1</a><a id="other">2</a><a href>3</a>'
    assert texts(spark, html, Selector(tag="a", id_prefix="thread_title_"), text_joined) == ["1"]
    assert texts(spark, html, Selector(tag="a", has_href=True), text_joined) == ["1", "3"]


def test_duplicate_attribute_keeps_the_last(spark):
    assert texts(spark, '<p class="a" class="b">x</p>', Selector(cls="b"), text_joined) == ["x"]


def test_lookup_inside_an_element(spark):
    html = "<div><i>a</i></div><i>out</i><div><u><i>b</i></u><i>c</i></div><div></div>"
    inner = F.transform(
        find_all("page.nodes", Selector(tag="div")),
        lambda n: text_joined("page.texts", find(below("page.nodes", n), Selector(tag="i"))),
    )
    assert parsed(spark, html).select(inner.alias("t")).first()["t"] == ["a", "b", None]


def test_zip_stops_at_the_shorter_list(spark):
    html = "<p>1</p><p>2</p><p>3</p><i>a</i><i>b</i>"
    for left, right in (("p", "i"), ("i", "p")):
        pairs = zip_truncate(
            find_all("page.nodes", Selector(tag=left)),
            find_all("page.nodes", Selector(tag=right)),
            lambda a, b, i: F.concat_ws(
                ":", i, text_joined("page.texts", a), text_joined("page.texts", b)
            ),
        )
        got = parsed(spark, html).select(pairs.alias("t")).first()["t"]
        assert [x[0] for x in got] == ["0", "1"]


def test_null_and_empty_pages(spark):
    rows = parsed(spark, None, "", "plain").select("page").collect()
    assert [r["page"] and (list(r["page"]["texts"]), len(r["page"]["nodes"])) for r in rows] == [
        None, ([], 0), (["plain"], 0),
    ]


def test_deep_unclosed_tags_stay_linear():
    texts_, nodes = outline("<b>x" * 20000)
    assert len(texts_) == len(nodes) == 20000
    assert nodes[0][1] == 19999


def test_pages_are_parsed_once_even_under_a_filter(spark):
    df = parsed(spark, "<p>x</p>").where(F.size("page.nodes") > 0)
    df = df.select(F.explode("page.nodes")).where("col.tag = 'p'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
