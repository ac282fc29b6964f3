"""Nodes of static pages: intervals, concealed parts, labels."""

from veilgrain.sources import html

PAGE = """<html><head><title>t</title></head><body>
<div id="a"><p>one<p>two <b>three</b></div>
<label for="x">Name <i>full</i></label><input id="x" value="v"><label>Mail<input name="m"></label>
<div style="display: NONE"><p hidden>gone</p><input id="y"></div><p hidden>also<b>gone</b></p><span>after</span>
<ul><li>open<li><a href="/u" onclick="f()">link</a></ul><textarea placeholder="say">x</textarea><br><div>unclosed"""


def nodes(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return html.page_tree(frame)


def test_intervals_nest(spark):
    rows = sorted(nodes(spark, PAGE).collect(), key=lambda r: r.enter)
    assert [r.node_ord for r in rows] == list(range(1, len(rows) + 1))
    assert sorted([r.enter for r in rows] + [r.leave for r in rows]) == list(range(1, 2 * len(rows) + 1))
    for a in rows:
        for b in rows:
            assert a.leave < b.enter or b.leave < a.enter or (a.enter <= b.enter and b.leave <= a.leave) or (b.enter <= a.enter and a.leave <= b.leave)
    inside = {b.tag for b in rows if rows[0].enter < b.enter and b.leave < rows[0].leave}
    assert rows[0].id_attr == "a" and inside == {"p", "b"}
    assert [r.text for r in rows if r.tag == "p"][:2] == ["one", ""]
    assert [r.attributes for r in rows if r.tag == "a"] == [{"href": "/u"}]
    assert [(r.is_input, r.is_clickable, r.text) for r in rows if r.tag in ("textarea", "a")] == [(False, True, "link"), (True, False, "say")]


def test_concealed_parts_go_whole(spark):
    shown = html.visible_nodes(nodes(spark, PAGE, "<body><p>x</p></body>", None, "")).collect()
    assert {r.page_id for r in shown} == {0, 1}
    assert not any("gone" in r.own_text or "also" in r.own_text or r.id_attr == "y" for r in shown)
    assert {"after", "unclosed", "link"} <= {r.own_text for r in shown}


def test_labels(spark):
    found = {r.id_attr or r.name_attr or r.tag: r.label for r in html.with_labels(nodes(spark, PAGE)).collect() if r.is_input}
    assert found == {"x": "Name full", "m": "Mail", "y": None, "textarea": None}
    assert html.with_labels(nodes(spark, PAGE)).count() == nodes(spark, PAGE).count()
