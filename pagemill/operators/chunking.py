"""Pages to citation-sized chunks, chunks to retrieval windows: folds over the paragraphs of a text, a row at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import PARAGRAPH, SPACES, embed_text

LEAST, MOST, OVERLAP = 200, 2000, 200
WINDOW_MOST, WINDOW_OVERLAP, WINDOW_LEAST = 600, 120, 150
SLACK = 1.5


def fold_small(parts: list[str], least: int) -> list[str]:
    """Parts under `least` characters joined to the one before; a small first one to the one after."""
    out: list[str] = []
    for part in parts:
        if out and len(part) < least:
            out[-1] = f"{out[-1]}\n\n{part}"
        else:
            out.append(part)
    if len(out) >= 2 and len(out[0]) < least:
        out[:2] = [f"{out[0]}\n\n{out[1]}"]
    return out


def sliced(parts: list[str], most: int, overlap: int) -> list[str]:
    """Parts over one and a half times `most` cut into overlapping slices of `most`."""
    return [s for p in parts for s in ([p] if len(p) <= int(most * SLACK) else [p[i : i + most] for i in range(0, len(p), most - overlap)])]


def _packed(pieces: list[str], most: int, overlap: int, least: int, between: str) -> list[str]:
    """Pieces put together until the next would make over `most` characters and there are `least`; each part is led by the end of the one before."""
    out, held = [], ""
    for piece in pieces:
        if len(held) >= least and len(held) + len(piece) + len(between) > most:
            out.append(held.strip())
            held = held[max(0, len(held) - overlap) :] + between + piece
        else:
            held = held + between + piece if held else piece
    rest = held.strip()
    return [*out, rest] if rest else out


def _by_row(split: Callable[[str], list[str]], text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else split(t) for t in texts], dtype=object)

    return run(text)


def split_long(text: Column, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, paragraph: str = PARAGRAPH) -> Column:
    """Parts of a long text, broken between paragraphs once the part at hand can stand alone."""
    ends = re.compile(paragraph)

    def split(whole: str) -> list[str]:
        return [whole] if len(whole) <= most else fold_small(sliced(_packed(ends.split(whole), most, overlap, least, "\n\n"), most, overlap), least)

    return _by_row(split, text)


def split_windows(text: Column, most: int = WINDOW_MOST, overlap: int = WINDOW_OVERLAP, least: int = WINDOW_LEAST, paragraph: str = PARAGRAPH) -> Column:
    """The windows of a chunk: paragraphs, or sentences of long ones, packed up to `most`; never none."""
    ends, sentence = re.compile(paragraph), re.compile(rf"(?<=[.!?]){SPACES}+")

    def split(whole: str) -> list[str]:
        parts, held = [], ""
        for block in filter(None, map(str.strip, ends.split(whole))):
            for piece in [block] if len(block) <= most else _packed(sentence.split(block), most, overlap, 1, " "):
                if held and len(held) + len(piece) + 2 > most:
                    parts.append(held)
                    held = piece
                else:
                    held = f"{held}\n\n{piece}" if held else piece
        return fold_small(sliced([*parts, held] if held else parts, most, overlap), least) or [whole]

    return _by_row(split, text)


def merge_tiny(units: DataFrame, book: str = "book_file", position: str = "position", text: str = "text", least: int = LEAST) -> DataFrame:
    """Page units under `least` characters joined to the unit before, whose place they share; small leading ones to the one after.

    Which units go together is a running count of those that stand alone, so the fold is a window per book and a group.
    """
    order = W.partitionBy(book).orderBy(position)
    alone = (F.length(text) >= least) | (F.row_number().over(order) == 1)
    grouped = units.withColumn("unit", F.sum(alone.cast("int")).over(order))
    others = [c for c in units.columns if c not in (book, position, text)]
    row = F.struct(position, F.col(text).alias("text"), *others)
    joined = grouped.groupBy(book, "unit").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    merged = joined.select(book, "unit", F.col("rows")[0].alias("head"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"))
    per_book = W.partitionBy(book).orderBy("unit")
    stub = (F.col("unit") == 1) & (F.length("text") < least) & (F.lead("unit").over(per_book).isNotNull())
    carried = F.lag(F.when(stub, F.col("text"))).over(per_book)
    full = F.when(carried.isNotNull(), F.concat(carried, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    out = merged.select("*", stub.alias("stub"), full.alias("full")).where("not stub")
    return out.select(book, F.col(f"head.{position}").alias(position), F.col("full").alias(text), *[F.col(f"head.{c}").alias(c) for c in others])


def chunk_units(units: DataFrame, paragraph: str = PARAGRAPH) -> DataFrame:
    """Chunks of page units (book_file, book_title, author, year, image, page, text), with ids, embed text and its SHA-1."""
    parts = units.select("book_file", "book_title", "author", "year", "image", "page", F.posexplode(split_long(F.col("text"), paragraph=paragraph)).alias("part", "text"))
    stem = F.regexp_replace("book_file", r"\.[^.]*$", "")
    ident = F.concat_ws("::", stem, F.col("image"), F.coalesce(F.nullif("page", F.lit("")), F.lit("-")), F.col("part").cast("string"))
    embedded = embed_text(F.col("book_title"), F.col("author"), F.col("page"), F.col("text"))
    return parts.select(ident.alias("id"), "book_file", "book_title", "author", "year", "image", "page", "text", embedded.alias("embed_text"), F.sha1(embedded).alias("content_sha"))


def chunk_windows(chunks: DataFrame, paragraph: str = PARAGRAPH) -> DataFrame:
    """Windows of chunks: id, chunk_id, ord, text (led by the citation header) and its SHA-1."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "book_title", "author", "page", F.posexplode(split_windows(F.col("text"), paragraph=paragraph)).alias("ord", "window"))
    text = embed_text(F.col("book_title"), F.col("author"), F.col("page"), F.col("window"))
    return rows.select(F.concat("chunk_id", F.lit("::w"), F.col("ord").cast("string")).alias("id"), "chunk_id", "ord", text.alias("text"), F.sha1(text).alias("content_sha"))
