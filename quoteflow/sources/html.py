"""Tables and elements of HTML pages, by pattern, inside the JVM.

``html_tables`` reads tables that nest: a page is cut into tags and texts, and a running count of
opened less closed tables gives every token its depth, as brackets are matched.  A token belongs to the table opened
last at its depth.  The counts are window sums over a page's tokens, so a page is one task's work, as it is as a value.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wanted table class prefix, and column names when a table has no header cells
TABLE_CLASS = "tb10"
DEFAULT_HEADERS = ["Company", "Market Cap", "Market Price", "Sector"]

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def elements(html: Column, tag: str) -> Column:
    """Inner markup of every ``<tag>`` element, in page order (elements of one tag do not nest)."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def inner_text(markup: Column) -> Column:
    """Text of a piece of markup: tags removed, common entities resolved, trimmed."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    for entity, character in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_items(pages: DataFrame, tag: str = "li", key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, position, text)`` for every ``<tag>`` element."""
    return pages.select(key, F.posexplode(elements(F.col(html), tag)).alias("position", "_markup")).select(
        key, "position", inner_text(F.col("_markup")).alias("text")
    )


def html_table(
    pages: DataFrame, class_prefix: str = TABLE_CLASS, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """Rows of each page's first table with a class starting with ``class_prefix``.

    ``(key, row_number, headers, cells)``: headers are the ``th`` texts, else
    the default names, cut to the number of cells.  Rows are those of ``tbody``,
    else all but the first; rows without ``td`` cells are left out.
    """
    opening = rf"""<table\b[^>]*?\bclass\s*=\s*["']?(?:[^"'>]*\s)?{class_prefix}[^>]*>"""
    table = F.regexp_extract(html, rf"(?is){opening}(.*?)</table\s*>", 1)
    body = F.regexp_extract("_table", r"(?is)<tbody(?:\s[^>]*)?>(.*?)</tbody\s*>", 1)
    has_body = F.col("_table").rlike(r"(?i)<tbody[\s>]")
    all_rows = elements(F.col("_table"), "tr")
    rows = F.when(has_body, elements(body, "tr")).otherwise(F.slice(all_rows, 2, F.greatest(F.size(all_rows), F.lit(1))))
    headers = F.transform(elements(F.col("_table"), "th"), inner_text)
    defaults = F.array(*[F.lit(h) for h in DEFAULT_HEADERS])
    return (
        pages.select(key, table.alias("_table"))
        .filter(F.col("_table") != "")
        .select(
            key,
            F.when(F.size(headers) > 0, headers).otherwise(defaults).alias("headers"),
            F.posexplode(rows).alias("row_number", "_row"),
        )
        .withColumn("cells", F.transform(elements(F.col("_row"), "td"), inner_text))
        .filter(F.size("cells") > 0)
        .select(key, "row_number", F.slice("headers", 1, F.size("cells")).alias("headers"), "cells")
    )


def unescaped(text: Column) -> Column:
    """Character references resolved: decimal, hexadecimal, and the named ones of HTML 4; others stay as they are."""
    names = F.from_json(F.lit(json.dumps(name2codepoint)), "map<string,int>")
    pieces = F.regexp_extract_all(text, F.lit(r"&#?[0-9a-zA-Z]+;|&|[^&]+"), F.lit(0))

    def resolved(piece: Column) -> Column:
        number = (
            F.when(piece.rlike("^&#[0-9]{1,7};$"), F.regexp_extract(piece, "^&#([0-9]+);$", 1).try_cast("int"))
            .when(piece.rlike("^&#[xX][0-9a-fA-F]{1,6};$"), F.conv(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10).try_cast("int"))
            .when(piece.rlike("^&[a-zA-Z][0-9a-zA-Z]*;$"), F.element_at(names, F.regexp_extract(piece, "^&([0-9a-zA-Z]+);$", 1)))
        )
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number).otherwise(0).cast("bigint")), 8, "0")), "UTF-32")
        return F.when(known, character).otherwise(piece)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, resolved), "")).otherwise(text)


# comments, scripts and styles are one token each, then tags, then text
_TOKENS = r"(?is)<!--.*?-->|<(?:script)\b.*?</script\s*>|<(?:style)\b.*?</style\s*>|<[^>]*>|[^<]+|<"


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every cell of every table, tables inside cells included:
    ``(key, table_number, depth, row_number, cell_number, header, text)``, all numbers from 1.

    Tables are numbered as they open; an outer table has depth 1.  ``text`` is the cell's own, without that of tables inside it, tags
    removed, references resolved and trimmed; ``header`` tells ``th`` from ``td``.  Text outside cells belongs to none.  A closing tag
    without its opening counts for nothing, a table that is never closed ends with the page, a cell or row ends where the next begins.
    Null and empty pages have no cells.
    """
    numbered = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"), F.monotonically_increasing_id().alias("_page"))
    found = F.posexplode(F.regexp_extract_all("_html", F.lit(_TOKENS), F.lit(0))).alias("_at", "_token")
    tokens = numbered.select("_key", "_page", found)
    name = F.lower(F.regexp_extract("_token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    tags = tokens.withColumn("_name", name).withColumn("_open", ~F.col("_token").startswith("</"))
    # comments and the like are dropped, whose text is no text; tags that are no part of a table only separate nothing
    part = F.col("_name").isin("table", "tr", "td", "th")
    kept = tags.filter(part | ~F.col("_token").startswith("<") | (F.col("_token") == "<"))

    page = Window.partitionBy("_page").orderBy("_at")
    step = F.when(F.col("_name") != "table", 0).when(F.col("_open"), 1).otherwise(-1)
    # closings without an opening are taken off again: the sum never counts below its lowest point so far
    counted = kept.withColumn("_sum", F.sum(step).over(page)).withColumn("_low", F.least(F.min("_sum").over(page), F.lit(0)))
    opens = F.when((F.col("_name") == "table") & F.col("_open"), 1).otherwise(0)
    placed = counted.withColumns({"depth": F.col("_sum") - F.col("_low"), "_opened": F.sum(opens).over(page)})
    inside = placed.filter("depth > 0")

    # the table opened last at this depth, its rows and cells so far
    level = Window.partitionBy("_page", "depth").orderBy("_at")
    owned = inside.withColumn("table_number", F.max(F.when(opens == 1, F.col("_opened"))).over(level))
    table = Window.partitionBy("_page", "depth", "table_number").orderBy("_at")
    begins = lambda *names: F.when(F.col("_name").isin(*names) & F.col("_open"), 1).otherwise(0)
    rowed = owned.withColumn("row_number", F.sum(begins("tr")).over(table))
    row = Window.partitionBy("_page", "depth", "table_number", "row_number").orderBy("_at")
    cell = F.when(F.col("_name").isin("td", "th", "tr"), F.when(F.col("_open") & (F.col("_name") != "tr"), F.col("_name")).otherwise(F.lit("")))
    celled = rowed.withColumns({"cell_number": F.sum(begins("td", "th")).over(row), "_cell": F.last(cell, True).over(row)})

    own = F.when(F.col("_name") == "", F.col("_token")).otherwise(F.lit(""))
    pieces = celled.filter((F.col("_cell") != "") & (F.col("cell_number") > 0) & (F.col("row_number") > 0))
    cells = pieces.groupBy("_page", "depth", "table_number", "row_number", "cell_number").agg(
        F.first("_key").alias(key), F.first("_cell").alias("_cell"), F.array_sort(F.collect_list(F.struct("_at", own.alias("text")))).alias("_texts")
    )
    text = F.regexp_replace(unescaped(F.array_join(F.col("_texts.text"), "")), r"^\s+|\s+$", "")
    numbers = [F.col(c).cast("int").alias(c) for c in ("table_number", "depth", "row_number", "cell_number")]
    return cells.select(key, *numbers, (F.col("_cell") == "th").alias("header"), text.alias("text"))
