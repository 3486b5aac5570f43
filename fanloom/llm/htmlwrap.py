"""HTML extraction by wrapper induction.

1. Every page is parsed to a tree of its block elements with a leaf for each run of text (inline elements belong to
   the text around them; scripts, styles and comments are left out, all other text is kept). Neighbouring siblings of equal structure become
   one repeated node. The tree without texts is the page's shape.
2. The shapes of a host are aligned by simple tree matching, the most frequent first: each is matched with the host's
   template tree, and nodes without a partner are inserted next to the siblings that have one.
3. At every template node, a text that stands on at least ``CONSTANT`` of the host's pages that have the node, and on
   two pages or more, is template; all other texts are slots, and their texts, in the order of the page, the content.
   Pages are counted over the whole table.

Defined cases
    null or empty html: empty content, no texts. Null, empty or odd address: the host is the empty string. Null page id:
    a page like any other. Repeated rows: each is a page, is counted and returned. A host with one page: no template,
    all text is content. Broken markup: unclosed elements end with their parent or by the usual rules for paragraphs,
    items and cells; stray ends are ignored; a tag without its end is text. Elements may lie as deep as they like. Very
    long pages: whole, in time that grows with their length. Empty table: no rows. Further columns: ignored.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.llm.keys import sized_join
from fanloom.session import materialise

CONSTANT = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_RAW = frozenset("script style".split())
_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("table ul ol dl td th body html div article section nav footer header".split())


class Node:
    __slots__ = ("tag", "kids", "shape", "number")

    def __init__(self, tag: str):
        self.tag, self.kids, self.shape, self.number = tag, [], -1, -1


def parse(page: str) -> tuple[Node, list[tuple[Node, str]], str]:
    """(root, [(leaf, text)] in order, title)."""
    root = Node("#root")
    path, texts, run, title = [root], [], [], []
    opened: dict[str, list[int]] = {}  # where the open elements of a tag stand in the path
    scopes = [0]
    at, n = 0, len(page)
    last = page.rfind(">")

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if not text:
            return
        if path[-1].tag == "title":
            title.append(text)
        else:
            leaf = Node("#")
            path[-1].kids.append(leaf)
            texts.append((leaf, text))

    def close_from(k: int):
        for node in path[k:]:
            opened[node.tag].pop()
        del path[k:]
        while scopes[-1] >= k:
            scopes.pop()

    while at < n:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in _INLINE:
                continue
            flush()
            if opened.get(tag):
                close_from(opened[tag][-1])
            continue
        if tag in _INLINE:
            continue
        flush()
        if tag in _RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID:
            continue
        close = _CLOSES.get(tag, frozenset())
        if tag in _ENDS_P:
            close = close | {"p"}
        k = max((opened[c][-1] for c in close if opened.get(c)), default=0)
        if k and k >= scopes[-1]:
            close_from(k)
        node = Node(tag)
        path[-1].kids.append(node)
        if not m.group(3).endswith("/"):
            opened.setdefault(tag, []).append(len(path))
            if tag in _SCOPE:
                scopes.append(len(path))
            path.append(node)
    flush()
    return root, texts, " ".join(title)


def shape_of(root: Node) -> str:
    """Numbers the nodes in order, neighbours of equal shape by the same numbers, and returns the tree's shape."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.kids
    known: dict[tuple, int] = {}
    size: list[int] = []  # nodes of the collapsed trees
    for node in reversed(order):
        kids: list[int] = []
        for k in node.kids:
            if not kids or k.shape != kids[-1]:
                kids.append(k.shape)
        node.shape = known.setdefault((node.tag, *kids), len(known))
        if node.shape == len(size):
            size.append(1 + sum(size[k] for k in kids))
    root.number = 0
    stack = [root]
    while stack:
        node = stack.pop()
        free, last = node.number + 1, None
        for k in node.kids:
            if last is None or k.shape != last.shape:
                k.number = free
                free += size[k.shape]
            else:
                k.number = last.number
            last = k
        stack += node.kids
    made = list(known)
    out: list[str] = []
    work: list = [root.shape]
    while work:
        k = work.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        tag, *below = made[k]
        out.append(tag)
        if below:
            out.append("(")
            work.append(")")
            for j, kid in enumerate(reversed(below)):
                work += [" ", kid] if j else [kid]
    return "".join(out)


class Tree:
    """A node of a shape or of a template."""

    __slots__ = ("tag", "kids", "number")

    def __init__(self, tag: str, number: int):
        self.tag, self.kids, self.number = tag, [], number


def read_shape(shape: str) -> Tree:
    """The tree of a shape, numbered as ``shape_of`` does."""
    root, path, number = None, [], 0
    for token in re.findall(r"[^() ]+|[()]", shape):
        if token == "(":
            path.append(last)
        elif token == ")":
            last = path.pop()
        else:
            last = Tree(token, number)
            number += 1
            if path:
                path[-1].kids.append(last)
            else:
                root = last
    return root


def match(a: Tree, b: Tree, score: dict | None = None) -> int:
    """Simple tree matching: nodes in the largest common top-down matching that keeps order and parents."""
    if score is None:
        score = {}
    if a.tag != b.tag:
        return 0
    pairs = [(a, b)]  # parents before their children
    for x, y in pairs:
        pairs += [(v, w) for v in x.kids for w in y.kids if v.tag == w.tag]
    for x, y in reversed(pairs):
        before = [0] * (len(y.kids) + 1)
        for v in x.kids:
            now = [0] * len(before)
            for j, w in enumerate(y.kids, 1):
                both = score[v.number, w.number] if v.tag == w.tag else 0
                now[j] = max(now[j - 1], before[j], before[j - 1] + both)
            before = now
        score[x.number, y.number] = before[-1] + 1
    return score[a.number, b.number]


def align(template: Tree, page: Tree, free: int) -> tuple[dict[int, int], int]:
    """(page node -> template node, next free number): matched nodes, and inserted ones for those without a partner."""
    score: dict = {}
    match(template, page, score)
    to: dict[int, int] = {page.number: template.number}
    work = [(template, page)]

    def copy(node: Tree) -> Tree:
        nonlocal free
        top = Tree("", -1)
        todo = [(node, top)]
        while todo:
            own, above = todo.pop()
            new = Tree(own.tag, free)
            to[own.number] = free
            free += 1
            above.kids.append(new)
            todo += [(k, new) for k in reversed(own.kids)]
        return top.kids[0]

    while work:
        t, p = work.pop()
        n, m = len(t.kids), len(p.kids)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        w = [[score.get((x.number, y.number), 0) if x.tag == y.tag else 0 for y in p.kids] for x in t.kids]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1])
        i, j, partner = n, m, {}
        while i and j:
            if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
                i, j = i - 1, j - 1
                partner[j] = i
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        new, done = [], 0
        for j, y in enumerate(p.kids):
            if j in partner:
                new += t.kids[done : partner[j] + 1]
                done = partner[j] + 1
                to[y.number] = t.kids[partner[j]].number
                work.append((t.kids[partner[j]], y))
            else:
                new.append(copy(y))
        t.kids = new + t.kids[done:]
    return to, free


def induce(shapes: list[str]) -> list[list[int]]:
    """For each shape of a host (the most frequent first), the template node of each of its nodes."""
    template, free, out = None, 0, []
    for shape in shapes:
        tree = read_shape(shape)
        if template is None:
            template = read_shape(shape)
            free = len(re.findall(r"[^() ]+", shape))
            out.append(list(range(free)))
            continue
        to, free = align(template, tree, free)
        out.append([to[k] for k in range(len(to))])
    return out


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def run(batches):
        for batch in batches:
            shapes, titles, nodes, texts = [], [], [], []
            for page in batch.column(3).to_pylist():
                root, found, title = parse(page or "")
                shapes.append(shape_of(root))
                titles.append(title)
                nodes.append([leaf.number for leaf, _ in found])
                texts.append([text for _, text in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(shapes, pa.string()), pa.array(titles, pa.string()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))],
                names=["page_id", "url", "host", "shape", "title", "nodes", "texts"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, shape string, title string, nodes array<int>, texts array<string>").withColumn("shape_id", F.xxhash64("shape"))


def wrappers(pages: DataFrame, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """The parsed pages, and (host, shape_id, at, fixed): template nodes of the shape's nodes, and the hashes of the
    constant texts with their nodes."""
    rows = materialise(parsed(pages), "parsed")
    counts = rows.groupBy("host", "shape_id").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "shape"], ascending=[False, True])
        return pdf[["host", "shape_id", "n"]].assign(at=induce(list(pdf["shape"])))

    maps = materialise(counts.groupBy("host").applyInPandas(run, "host string, shape_id long, n long, at array<int>"), "shapes")
    leaves = sized_join(rows.select("host", "shape_id", "nodes", "texts"), maps.select("host", "shape_id", "at"), ["host", "shape_id"], "inner", 20_000)
    spots = F.array_distinct(F.transform(F.arrays_zip("nodes", "texts"), lambda x: F.struct(F.element_at("at", x["nodes"] + 1).alias("node"), F.xxhash64(x["texts"]).alias("h"))))
    each = leaves.select("host", F.explode(spots).alias("s")).groupBy("host", "s.node", "s.h").agg(F.count(F.lit(1)).alias("pages"))
    here = maps.select("host", F.explode(F.array_distinct("at")).alias("node"), "n").groupBy("host", "node").agg(F.sum("n").alias("of"))
    fixed = each.where("pages >= 2").join(here, ["host", "node"]).where(F.col("pages") >= constant * F.col("of")).select("host", "node", "h")
    per_host = fixed.groupBy("host").agg(F.collect_set(F.struct("node", "h")).alias("fixed"))
    return rows, maps.select("host", "shape_id", "at").join(per_host, "host", "left")


def extract(pages: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """(page_id, url, host, title, content, n_texts, n_template), a row for each page."""
    rows, wrap = wrappers(pages, constant)
    joined = sized_join(rows.drop("shape"), wrap, ["host", "shape_id"], "left", 20_000)
    none = F.array().cast("array<struct<node:int,h:bigint>>")
    slot = F.filter(
        F.arrays_zip("nodes", "texts"),
        lambda x: ~F.array_contains(F.coalesce("fixed", none), F.struct(F.element_at("at", x["nodes"] + 1).alias("node"), F.xxhash64(x["texts"]).alias("h"))),
    )
    out = joined.withColumn("slots", slot)
    return out.select(
        "page_id", "url", "host", "title",
        F.array_join(F.col("slots.texts"), "\n").alias("content"),
        F.size("texts").alias("n_texts"),
        (F.size("texts") - F.size("slots")).alias("n_template"),
    )


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), CONSTANT)
