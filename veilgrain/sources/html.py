"""Static HTML pages to node rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("node_ord", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("placeholder", T.StringType()),
        T.StructField("input_type", T.StringType()),
        T.StructField("name_attr", T.StringType()),
        T.StructField("id_attr", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_input", T.BooleanType()),
        T.StructField("is_clickable", T.BooleanType()),
    ]
)
#: Nodes with their place in the tree: an element lies inside another one if its interval does.
TREE_SCHEMA = T.StructType(
    [
        *NODE_SCHEMA.fields,
        T.StructField("enter", T.IntegerType()),
        T.StructField("leave", T.IntegerType()),
        T.StructField("conceals", T.BooleanType()),
        T.StructField("own_text", T.StringType()),
    ]
)

_SKIPPED = {"script", "style", "noscript"}
_INPUTS = {"input", "textarea", "select"}
_HIDDEN_ATTRS = {"style", "class", "onclick"}
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
# An opening tag on the left ends an open element listed on the right.
_IMPLIED_END = {
    "li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
}
_BLOCKS = {
    "article", "div", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "pre", "section", "table", "ul",
}


class _BodyNodes(HTMLParser):
    """Elements of one body, with text kept for leaves only."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.mute = 0
        self.in_head = False
        self.clock = 0

    def _tick(self) -> int:
        self.clock += 1
        return self.clock

    def _shut(self, depth: int) -> None:
        """Leave the open elements from ``depth`` on, the innermost first."""
        while len(self.open) > depth:
            self.open.pop()["leave"] = self._tick()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.mute += 1
            return
        if tag == "head":
            self.in_head = True
        if tag == "body":
            self.in_head = False
        if self.mute or self.in_head or tag in ("html", "head", "body"):
            return
        closes = set(_IMPLIED_END.get(tag, ()))
        if tag in _BLOCKS:
            closes.add("p")
        if closes and self.open and self.open[-1]["tag"] in closes:
            self._shut(len(self.open) - 1)
        if self.open:
            self.open[-1]["children"] += 1
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": [], "children": 0, "enter": self._tick()}
        self.nodes.append(node)
        self.open.append(node)
        if tag in _VOID:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.mute = max(0, self.mute - 1)
            return
        if tag == "head":
            self.in_head = False
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._shut(depth)
                return

    def handle_data(self, data):
        if not self.mute and not self.in_head and self.open:
            self.open[-1]["text"].append(data)


def _rows_of(page_id: int, html: str) -> Iterator[tuple]:
    parser = _BodyNodes()
    parser.feed(html)
    parser.close()
    parser._shut(0)
    for order, node in enumerate(parser.nodes, start=1):
        attrs = node["attrs"]
        is_input = node["tag"] in _INPUTS
        if is_input:
            text = attrs.get("value") or attrs.get("placeholder") or ""
        else:
            text = "".join(node["text"]).strip() if node["children"] == 0 else ""
        yield (
            page_id,
            order,
            node["tag"],
            attrs.get("role"),
            text,
            attrs.get("placeholder"),
            attrs.get("type"),
            attrs.get("name"),
            attrs.get("id"),
            {k: v for k, v in attrs.items() if k not in _HIDDEN_ATTRS},
            is_input,
            node["tag"] in ("button", "a") or attrs.get("role") == "button" or "onclick" in attrs,
            node["enter"],
            node["leave"],
            "hidden" in attrs or _NO_DISPLAY.search(attrs.get("style", "").lower()) is not None,
            "".join(node["text"]).strip(),
        )


#: Nodes handed back at once; a batch of pages holds many times as many.
_NODES = 4096


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = TREE_SCHEMA.fieldNames()
    for batch in batches:
        rows = (
            row
            for page_id, html in zip(batch["page_id"], batch["html"])
            if html is not None
            for row in _rows_of(page_id, html)
        )
        while piece := list(islice(rows, _NODES)):
            yield pd.DataFrame(piece, columns=names)


def page_tree(pages: DataFrame) -> DataFrame:
    """``page_id, html`` to nodes with their intervals; a narrow step, one page at a time, no shuffle.

    ``enter`` and ``leave`` number the places where elements begin and end, so one
    element lies inside another exactly if its interval does. ``conceals`` marks an
    element that is not displayed, with all inside it; ``own_text`` is the text
    directly inside.
    """
    return pages.select("page_id", "html").mapInPandas(_parse, TREE_SCHEMA)


def page_nodes(pages: DataFrame) -> DataFrame:
    """``page_id, html`` to nodes."""
    return page_tree(pages).select(*NODE_SCHEMA.fieldNames())


def visible_nodes(tree: DataFrame) -> DataFrame:
    """The nodes that lie in no concealed element.

    Intervals nest, so a node is inside one of the concealed elements before it if the
    latest end of those lies behind its own: a running maximum, no join.
    """
    before = Window.partitionBy("page_id").orderBy("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.max(F.when(F.col("conceals"), F.col("leave"))).over(before)
    shown = tree.withColumn("_until", until).filter(F.col("_until").isNull() | (F.col("_until") < F.col("leave")))
    return shown.drop("_until")


def with_labels(tree: DataFrame) -> DataFrame:
    """Nodes with ``label``: for an input, the text of the label that is for its id, else of the one around it.

    Labels do not nest, so the last label that begins before an element is the only
    one that can hold it. Its text is that of all elements inside, in order.
    """
    before = Window.partitionBy("page_id").orderBy("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("tag") == "label", F.struct("enter", "leave", F.col("attributes")["for"].alias("target")))
    placed = tree.withColumn("_label", F.last(own, ignorenulls=True).over(before))
    inside = F.when(F.col("_label.leave") >= F.col("leave"), F.col("_label.enter"))
    placed = placed.withColumn("_inside", inside).withColumn("_for", F.when(F.col("_inside").isNotNull(), F.col("_label.target"))).drop("_label")
    words = placed.filter("_inside is not null and own_text <> ''").groupBy("page_id", "_inside", "_for").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("enter", "own_text"))), lambda x: x["own_text"]), " ").alias("_words")
    )
    around = words.select("page_id", "_inside", F.col("_words").alias("_around"))
    named = words.filter("_for is not null").groupBy("page_id", F.col("_for").alias("id_attr")).agg(F.min_by("_words", "_inside").alias("_named"))
    joined = placed.drop("_for").join(around, ["page_id", "_inside"], "left").join(named, ["page_id", "id_attr"], "left")
    label = F.when(F.col("is_input"), F.coalesce("_named", "_around"))
    return joined.select(*tree.columns, label.alias("label"))
