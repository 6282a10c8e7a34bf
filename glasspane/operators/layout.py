"""Pages as tables of nodes: what a reader can see of a text, by the styles of the elements around it.

A page is read once into rows (page, node, parent). Everything that is handed down a tree (why something is hidden, colours,
the background, the size of letters, the block) is the nearest value among a node and its ancestors; `nearest` deals the nodes
out by page, once, and finds it for many pages together by pointer doubling, in the logarithm of the deepest tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions.text import text_slices
from .pages import CSS_RULE, STYLE_BLOCK, VOIDS, Events, shown_events

SELECTOR = re.compile(r"[.#]?[\w-]+")
NODES = [("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("css", pa.string()), ("classes", pa.list_(pa.string())), ("concealed", pa.bool_()), ("text", pa.string())]


def style_rules(html: str) -> dict[str, str]:
    """Declarations of a page's style blocks by their lone selector: a tag, .class or #id; later ones follow earlier ones."""
    out: dict[str, str] = {}
    for rule in CSS_RULE.finditer(" ".join(m[1] for m in STYLE_BLOCK.finditer(html)).lower()):
        for name in rule["names"].split(","):
            if SELECTOR.fullmatch(name.strip()):
                out[name.strip()] = f"{out.get(name.strip(), '')};{rule['body']}"
    return out


def node_rows(html: str) -> Iterator[tuple]:
    """Rows of NODES in document order. Node 0 is the root; texts are nodes without a tag; blank texts and those of elements that show none are left out."""
    rules, opened, count = style_rules(html), Counter(), 0
    stack = [(0, "", False)]
    yield 0, None, "", "", [], False, None

    def leave(tag):
        done = False
        while not done:
            gone = stack.pop()[1]
            opened[gone] -= 1
            done = gone == tag

    for event in shown_events(Events(html).list):
        kind = event[0]
        if kind == "open" and event[1] not in VOIDS:
            tag, attrs = event[1:3]
            if tag == "body" and opened["head"]:
                leave("head")
            count += 1
            classes = attrs.get("class", "").lower().split()
            names = [tag, *(f".{c}" for c in classes), "#" + attrs.get("id", "").lower()]
            yield count, stack[-1][0], tag, ";".join([*(rules[x] for x in names if x in rules), attrs.get("style", "").lower()]), classes, "hidden" in attrs, None
            stack.append((count, tag, stack[-1][2] or tag in V.UNREAD_TAGS))
            opened[tag] += 1
        elif kind == "close" and opened[event[1]]:
            leave(event[1])
        elif kind == "text" and event[1].strip() and not stack[-1][2]:
            count += 1
            yield count, stack[-1][0], None, None, None, None, event[1]


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, node, parent, tag, css, classes, concealed, text), see node_rows; null and empty html has no nodes, ids are to be unique."""
    key = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, end in text_slices(batch.column("html")):
                rows = [(i, *row) for i in range(a, end) if (html := batch.column("html")[i].as_py()) for row in node_rows(html)]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *(pa.array(c, kind) for c, (_, kind) in zip(columns, NODES, strict=True))], ["page_id", *(name for name, _ in NODES)])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {key}, node int, parent int, tag string, css string, classes array<string>, concealed boolean, text string")


def whole_pages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by page: tables of whole pages, of `least` rows or more but for the last, and where each page ends."""
    held, rows, wanted = [], 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = page_ends(table)
            if len(ends) > 1:
                yield table.slice(0, ends[-2]), ends[:-1]
                table = table.slice(ends[-2])
            held, rows, wanted = table.to_batches(), len(table), max(least, 2 * len(table))
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, page_ends(table)


def page_ends(table: pa.Table) -> np.ndarray:
    return pc.run_end_encode(table.column("page_id").combine_chunks()).run_ends.to_numpy() if len(table) else np.zeros(0, np.int32)


def holders(table: pa.Table, ends: np.ndarray, column: str) -> np.ndarray:
    """For each row of whole pages, sorted by page and node: the row of the nearest value, -1 without one."""
    first = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) << 32
    key, parent = first + table.column("node").to_numpy(), table.column("parent")
    wanted = first + pc.fill_null(parent, 0).to_numpy()
    up = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    known = (key[up] == wanted) & ~parent.is_null().to_numpy() & ~table.column("page_id").is_null().to_numpy()
    up = np.where(known, up, -1)
    at = np.where(table.column(column).is_null().to_numpy(), -1, np.arange(len(key)))
    while len(rest := np.flatnonzero((at < 0) & (up >= 0))):
        # Both are read before either is written: each round looks twice as far up.
        at[rest], up[rest] = at[up[rest]], up[up[rest]]
    return at


def nearest(nodes: DataFrame, columns: list[str], kept: Sequence[str] = (), least: int = 1 << 14) -> DataFrame:
    """nodes (page_id, node, parent, columns) with each column's nearest value that is not null, from the node up to the root;
    columns of `kept` stay as they are.

    The nodes of a page meet in one task, as its html did, and many pages are gone through together by pointer doubling.
    Parents that are not in the table end the way.
    """

    def run(batches):
        for table, ends in whole_pages(batches, least):
            found = []
            for c in columns:
                at = holders(table, ends, c)
                found.append(table.column(c).take(pa.array(at, mask=at < 0)))
            yield from pa.table([*(table.column(c) for c in ("page_id", "node", *kept)), *found], ["page_id", "node", *kept, *columns]).to_batches()

    rows = nodes.select("page_id", "node", "parent", *kept, *columns).repartition("page_id").sortWithinPartitions("page_id", "node")
    return rows.mapInArrow(run, rows.drop("parent").schema)


def declared(name: str) -> Column:
    """The last value that an element's declarations give a property; null if none."""
    said = F.regexp_extract_all("css", F.lit(rf"(?:^|[;\s]){name}\s*:\s*([^;!]+)"), F.lit(1))
    return F.nullif(F.trim(F.try_element_at(said, F.lit(-1))), F.lit(""))


def pixels(value: Column) -> Column:
    """A length in pixels; null without a number. Lengths relative to letters count against 16 pixels."""
    number = F.nullif(F.regexp_extract(value, r"^(-?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).cast("double")
    unit = F.regexp_extract(value, r"^-?[\d.]+\s*([a-z%]*)", 1)
    return number * F.when(unit == "pt", 4 / 3).when(unit.isin("em", "rem"), 16.0).when(unit == "%", 0.16).otherwise(1.0)


def colour(value: Column) -> Column:
    """Array (red, green, blue, opacity) of a colour: hexadecimal, rgb() and rgba(), or a basic name; null for others."""
    digits = F.regexp_extract(value, r"#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3,4})(?![0-9a-f])", 1)
    full = F.when(F.length(digits) < 5, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("double")
    of_digits = F.when(digits != "", F.array(part(1), part(3), part(5), F.when(F.length(full) == 8, part(7) / 255).otherwise(1.0)))
    said = F.regexp_extract_all(F.regexp_extract(value, r"rgba?\(([^)]*)\)", 1), F.lit(r"[\d.]+%?"), F.lit(0))
    # A share of a colour is of 255, a share of opacity of 1.
    numbers = F.transform(said, lambda x, i: F.regexp_extract(x, r"[\d.]+", 0).try_cast("double") * F.when(x.endswith("%"), F.when(i < 3, 2.55).otherwise(0.01)).otherwise(1.0))
    of_numbers = F.when(F.size(numbers) >= 3, F.concat(F.slice(numbers, 1, 3), F.array(F.coalesce(F.try_element_at(numbers, F.lit(4)), F.lit(1.0)))))
    names = F.create_map(*[x for name, rgb in V.COLOURS.items() for x in (F.lit(name), F.array(*map(F.lit, map(float, rgb))))])
    word = F.regexp_extract(value, r"(?<![\w(-])(" + "|".join(V.COLOURS) + r")(?![\w-])", 1)
    return F.coalesce(of_digits, of_numbers, F.try_element_at(names, F.nullif(word, F.lit(""))))


def own_reason() -> Column:
    """Why an element's own declarations hide it; null if they don't."""
    x, y, width, height = (pixels(declared(p)) for p in ("left", "top", r"width", r"height"))
    unknown = F.lit(V.UNKNOWN_PIXELS)
    beyond = (x + F.coalesce(width, unknown) <= 0) | (y + F.coalesce(height, unknown) <= 0) | (x >= V.PAGE_PIXELS + 500)
    reader = F.arrays_overlap("classes", F.array(*map(F.lit, V.SCREEN_READER_CLASSES)))
    return (
        F.when(F.col("concealed"), "hidden attribute")
        .when(declared("display") == "none", "display:none")
        .when(declared("visibility").isin("hidden", "collapse"), "visibility:hidden")
        .when(pixels(declared("opacity")) == 0, "opacity:0")
        .when(declared("content-visibility") == "hidden", "content-visibility:hidden")
        .when(reader, "screen-reader-only class")
        .when(declared("clip").rlike(r"^rect\(\s*0") | declared("clip-path").rlike(r"inset\(\s*(?:50|100)%"), "clipped away")
        .when(declared("transform").rlike(r"^(?:matrix\(0, ?0, ?0, ?0|scale(?:3d)?\(\s*0(?:\.0+)?\s*[,)])"), "scaled to zero")
        .when(declared("position").isin("absolute", "fixed") & F.coalesce(beyond, F.lit(False)), "moved off-screen")
        .when((declared("overflow(?:-[xy])?") == "hidden") & F.coalesce((width <= 1) | (height <= 1), F.lit(False)), "zero height")
        .when(declared("text-indent").rlike(r"^-\d{3,}"), "moved off-screen")
    )


def seen_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, node, text, reason, block, tag) of the texts of page_nodes; reason: why one can't be seen, empty where it can.

    What hides an element hides all in it, the nearest reason counts. Then a text may have letters of under two pixels, be
    transparent, or have nearly the colour of the nearest opaque background; before images colours are not judged. block and
    tag are of the nearest element that is laid out as a block, 0 and body outside of all.
    """
    shape = F.when(F.col("css") != "", declared("display"))
    behind = declared("background(?:-color|-image)?")
    painted = colour(declared("background(?:-color)?"))
    back = F.when(behind.rlike(r"url\(|gradient\("), F.array().cast("array<double>")).when(painted[3] > 0.9, painted)
    laid_out = F.when(shape.isNotNull(), ~shape.startswith("inline") & (shape != "contents")).otherwise(F.col("tag").isin(V.BLOCK_TAGS))
    root = F.col("parent").isNull()
    # Most elements declare nothing: only the others are looked at.
    said = lambda value, first: F.when(root, first).when(F.col("css") != "", value)
    own = nodes.where("page_id IS NOT NULL").select(
        "page_id", "node", "parent", "text",
        F.when(root, F.lit("")).when((F.col("css") != "") | (F.size("classes") > 0) | F.col("concealed"), own_reason()).alias("reason"),
        said(back, F.array(*map(F.lit, [255.0, 255.0, 255.0, 1.0]))).alias("back"),
        said(colour(declared("color")), F.array(*map(F.lit, [0.0, 0.0, 0.0, 1.0]))).alias("fore"),
        said(pixels(declared("font-size")), F.lit(16.0)).alias("letters"),
        F.when(root, F.struct(F.lit(0).alias("node"), F.lit("body").alias("tag"))).when(laid_out, F.struct("node", "tag")).alias("block"),
    )
    found = nearest(own, ["reason", "back", "fore", "letters", "block"], ["text"]).where("text IS NOT NULL")
    apart = F.aggregate(F.zip_with(F.slice("fore", 1, 3), F.slice("back", 1, 3), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    why = (
        F.when(F.col("reason") != "", F.col("reason"))
        .when(F.col("letters") < 2, "font-size:0")
        .when(F.col("fore")[3] == 0, "transparent text")
        .when((F.size("back") > 0) & (apart < V.COLOUR_DISTANCE), "text same colour as background")
        .otherwise("")
    )
    return found.select("page_id", "node", "text", why.alias("reason"), F.col("block.node").alias("block"), F.col("block.tag").alias("tag"))


def seen_chunks(texts: DataFrame) -> DataFrame:
    """seen_texts as chunks for page_reports: neighbouring texts of one block with one reason are one chunk (page_id, ord, text, where, how, tag)."""
    order = Window.partitionBy("page_id").orderBy("node")
    starts = F.coalesce((F.lag("block").over(order) != F.col("block")) | (F.lag("reason").over(order) != F.col("reason")), F.lit(True))
    runs = texts.withColumn("__start", starts).withColumn("__run", F.sum(F.col("__start").cast("int")).over(order))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "")
    out = runs.groupBy("page_id", "__run").agg(F.min("node").alias("ord"), said.alias("text"), F.first("reason").alias("how"), F.first("tag").alias("tag"))
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return out.select("page_id", "ord", text.alias("text"), F.when(F.col("how") == "", "visible").otherwise("hidden").alias("where"), "how", "tag").where("text <> ''")
