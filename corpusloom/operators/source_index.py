"""The source index as a table: matching, upsert, re-rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import link_key, product_key
from ..functions.strings import strip, text_or_empty
from ..functions.verdicts import READ_NO
from ..runtime import cut_lineage
from .ordered import block_of, with_neighbour

# Title, columns and blank mark of the rendered index.
INDEX_TITLE = "# 转写链接记录"
INDEX_COLUMNS = ("链接", "Extractor", "产物路径", "日期", "是否已精读")
INDEX_HEADER = "| " + " | ".join(INDEX_COLUMNS) + " |"
INDEX_SEPARATOR = "|" + "---|" * len(INDEX_COLUMNS)
BLANK_CELL = "—"
LOCAL_LINK, LOCAL_ADAPTER, NO_ADAPTER = "本地视频", "LocalMediaExtractor", "UnindexedSource"


def cell(value: Column) -> Column:
    text = strip(F.replace(text_or_empty(value), F.lit("|"), F.lit("\\|")))
    return F.when(text == "", F.lit(BLANK_CELL)).otherwise(text)


def render_row(link: Column, extractor: Column, product: Column, day: Column, read: Column) -> Column:
    return F.concat(
        F.lit("| "), cell(link), F.lit(" | "), cell(extractor), F.lit(" | `"), cell(product),
        F.lit("` | "), cell(day), F.lit(" | "), cell(read), F.lit(" |"),
    )


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("link_key", link_key(F.col("link"))).withColumn(
        "product_key", product_key(F.col("product"))
    )


def _obsolete(new: DataFrame) -> DataFrame:
    if "obsolete" not in new.columns:
        return new.select("product_key", "seq").limit(0)
    return new.select(F.explode("obsolete").alias("__o"), "seq").select(
        product_key(F.col("__o")).alias("product_key"), "seq"
    )


def _events(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link_key, seq) and (product_key, seq): what each incoming row matches by. Blank keys match nothing."""
    links = new.where(F.col("link_key") != "").select("link_key", "seq")
    products = new.where(F.col("product_key") != "").select("product_key", "seq").unionByName(_obsolete(new)).distinct()
    return links, products


def _classes(events: DataFrame, key: str, n: str, first: str) -> DataFrame:
    """One row per key: how many incoming rows match by it, and the first of them."""
    return events.groupBy(key).agg(F.count("seq").alias(n), F.min("seq").alias(first))


def _match(rows: DataFrame, classes: DataFrame, key: str, own: str) -> DataFrame:
    """Rows with the class of their key; a row without a key gets one that no other row has, so it is dealt out like any."""
    unique = F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("\x00"), F.col(own).cast("string")))
    return rows.withColumn("__own", unique).join(classes.withColumnRenamed(key, "__own"), "__own", "left").drop("__own")


def match_summary(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """row_no, links, products, first_seq of the index rows that incoming rows match.

    `links` incoming rows have its link, `products` its product or name it obsolete; first_seq is the first of
    all. Both sides meet as classes of a key, so a link that n rows and m incoming rows share costs n + m, not n m.
    """
    old, new = with_keys(index), with_keys(incoming)
    links, products = _events(new)
    found = _match(old.select("row_no", "link_key", "product_key"), _classes(links, "link_key", "links", "__by_link"), "link_key", "row_no")
    found = _match(found, _classes(products, "product_key", "products", "__by_product"), "product_key", "row_no")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("row_no", zero("links"), zero("products"), F.least("__by_link", "__by_product").alias("first_seq")).where(F.col("first_seq").isNotNull())


def match_rows(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """(row_no, seq) pairs: same link, same product, or product made obsolete.

    Every pair, so a key that n rows and m incoming rows share gives n m of them; `match_summary` gives the counts
    and the first match of each row at the cost of n + m. Rows without a key are left out before they are dealt out.
    """
    old, new = with_keys(index), with_keys(incoming)
    links, products = _events(new)
    left = old.select("row_no", "link_key", "product_key")
    pairs = [left.where(F.col(key) != "").join(events, key).select("row_no", "seq") for events, key in ((links, "link_key"), (products, "product_key"))]
    return pairs[0].unionByName(pairs[1]).distinct()


_CELLS = ("link", "extractor", "product", "day")


def _killers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every row version with the first later incoming row that matches it (null: it stays).

    A version can only be removed by a later incoming row with its link, its product, or its
    product on the obsolete list; the earliest of those does it. That makes the outcome of
    the one-by-one procedure a per-version minimum, without replaying it. No cells are carried.
    """
    links, products = _events(new)
    by_link = _classes(links, "link_key", "__n", "by_link").drop("__n")
    by_product = _classes(products, "product_key", "__n", "by_product").drop("__n")
    narrow = old.select("row_no", "link_key", "product_key", "read")
    nodes_old = _match(_match(narrow, by_link, "link_key", "row_no"), by_product, "product_key", "row_no").select(
        (-F.col("row_no") - 1).alias("node"),
        F.struct(F.lit(0).alias("k"), F.col("row_no").cast("long").alias("n")).alias("place"),
        "read", "product_key", F.least("by_link", "by_product").alias("killer"),
    )
    link_next = with_neighbour(
        links, ["link_key"], "seq", block_of(F.col("seq")), F.col("seq"), "by_link", after=True
    ).select("seq", "by_link")
    product_next = with_neighbour(
        products, ["product_key"], "seq", block_of(F.col("seq")), F.col("seq"), "by_product", after=True
    )
    nodes_new = (
        new.select("seq", "product_key").join(link_next, "seq", "left")
        .join(product_next, ["product_key", "seq"], "left")
        .select(
            F.col("seq").alias("node"),
            F.struct(F.lit(1).alias("k"), F.col("seq").cast("long").alias("n")).alias("place"),
            F.lit(READ_NO).alias("read"), "product_key", F.least("by_link", "by_product").alias("killer"),
        )
    )
    return nodes_old.unionByName(nodes_new)


def upsert(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index after all incoming rows (in `seq` order), exactly as if recorded one by one.

    `index`: row_no, link, extractor, product, day, read. `incoming`: seq (unique, >= 0),
    link, extractor, product, day and optionally obsolete (array of product paths).
    Result: row_kind (0 = place of an old row, 1 = appended), row_no, then the cells.

    Versions point to the row that removed them, which gives a forest; its roots are the rows
    that stay. A root takes the place of the foremost leaf below it, and keeps that leaf's
    read flag if the product never changed on the way. Roots are found by pointer doubling,
    so even one link updated n times takes log2(n) rounds. The loop carries numbers only; the
    cells are joined to the roots at the end.
    """
    old, new = with_keys(index), with_keys(incoming)
    nodes = cut_lineage(_killers(old, new))
    inner = nodes.where(F.col("killer").isNotNull())
    parents = nodes.select(
        F.col("node").alias("killer"), F.col("product_key").alias("__p"), F.col("killer").isNull().alias("done")
    )
    pointers = inner.join(parents, "killer").select(
        "node", F.col("killer").alias("root"), (F.col("product_key") == F.col("__p")).alias("same"), "done"
    )
    pointers = cut_lineage(pointers)
    while not pointers.where(~F.col("done")).isEmpty():
        step = pointers.select(
            F.col("node").alias("root"), F.col("root").alias("__r"), F.col("same").alias("__s"), F.col("done").alias("__d")
        )
        moved = (
            pointers.where(~F.col("done")).join(step, "root")
            .select("node", F.col("__r").alias("root"), (F.col("same") & F.col("__s")).alias("same"), F.col("__d").alias("done"))
        )
        pointers = cut_lineage(pointers.where("done").unionByName(moved))

    leaves = nodes.join(inner.select(F.col("killer").alias("node")).distinct(), "node", "left_anti")
    placed = leaves.join(pointers.select("node", "root", "same"), "node", "left").select(
        F.coalesce("root", "node").alias("node"),
        "place",
        F.when(
            (F.col("place")["k"] == 0) & F.coalesce("same", F.lit(True)), F.col("read")
        ).otherwise(READ_NO).alias("kept_read"),
    )
    front = placed.groupBy("node").agg(
        F.min("place").alias("front"), F.min_by("kept_read", "place").alias("kept_read")
    )
    cells = index.select((-F.col("row_no") - 1).alias("node"), *_CELLS).unionByName(incoming.select(F.col("seq").alias("node"), *_CELLS))
    return front.join(cells, "node").select(
        F.col("front")["k"].alias("row_kind"),
        F.col("front")["n"].alias("row_no"),
        *_CELLS,
        F.col("kept_read").alias("read"),
    )


def index_lines(rows: DataFrame) -> DataFrame:
    """Rendered row text with its order columns."""
    order = [c for c in ("row_kind", "row_no") if c in rows.columns]
    return rows.select(
        *order,
        render_row(*[F.col(c) for c in ("link", "extractor", "product", "day", "read")]).alias("line"),
    )
