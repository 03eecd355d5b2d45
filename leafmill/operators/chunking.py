"""Paragraph-aligned chunks of bounded length.

Short texts stay on the JVM; a text over the limit is cut by a table function of a lateral
join, in time linear in its length. The same rule as folds over arrays serves as a Column.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from leafmill.functions import strings as S

MAX_CHARS = 12_000
MAX_CHUNKS = 8


def _hard_split(paragraph: Column, most: int) -> Column:
    """Pieces of at most `most` characters, cut at a space where there is one.

    Two cuts use up more than `most` characters, which bounds the number of steps.
    """
    start = F.struct(paragraph.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        space = most - F.locate(" ", F.reverse(F.substring(acc["rest"], 1, most)))
        cut = F.when((space > 0) & (space < most), space).otherwise(F.lit(most))
        split = F.struct(S.py_lstrip(F.substring(acc["rest"], cut + 1, F.length(acc["rest"]))).alias("rest"), F.array_append(acc["out"], F.substring(acc["rest"], F.lit(1), cut)).alias("out"))
        return F.when(F.length(acc["rest"]) > most, split).otherwise(acc)

    steps = F.sequence(F.lit(1), F.floor(F.length(paragraph) * 2 / most).cast("int") + 2)
    return F.aggregate(steps, start, step, lambda acc: F.when(acc["rest"] != "", F.array_append(acc["out"], acc["rest"])).otherwise(acc["out"]))


def pieces(text: Column, most: int = MAX_CHARS) -> Column:
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), S.py_strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, _hard_split(p, most)).otherwise(F.array(p))))


def packed(parts: Column, most: int = MAX_CHARS) -> Column:
    """Greedy chunks of pieces; a piece costs its length and two more."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        cost = F.length(p) + 2
        fits = acc["size"] + cost <= most
        return (
            F.when(acc["size"] == 0, F.struct(p.alias("open"), cost.alias("size"), acc["done"].alias("done")))
            .when(fits, F.struct(F.concat(acc["open"], F.lit("\n\n"), p).alias("open"), (acc["size"] + cost).alias("size"), acc["done"].alias("done")))
            .otherwise(F.struct(p.alias("open"), cost.alias("size"), F.array_append(acc["done"], acc["open"]).alias("done")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["size"] > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def chunks(text: Column, most: int = MAX_CHARS) -> Column:
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed(pieces(text, most), most))


def cut_text(text: str, most: int) -> Iterator[str]:
    """The chunks of a text, one after the other: paragraphs, long ones cut by offsets at the last space, packed greedily."""

    def parts():
        for p in text.split("\n\n"):
            p, at = p.strip(), 0
            while len(p) - at > most:
                space = p.rfind(" ", at, at + most)
                cut = space if space > at else at + most
                yield p[at:cut]
                at = cut
                while at < len(p) and p[at].isspace():
                    at += 1
            if at < len(p):
                yield p[at:]

    if len(text) <= most:
        yield text
        return
    held, size = [], 0
    for p in parts():
        if size and size + len(p) + 2 > most:
            yield "\n\n".join(held)
            held, size = [], 0
        held.append(p)
        size += len(p) + 2
    if size:
        yield "\n\n".join(held)


@udtf(returnType="idx int, total int, chunk string, skipped_chars long", useArrow=True)
class Chunks:
    """Rows of chunk_table() for one text; limit -1 for none."""

    def eval(self, text: str, most: int, limit: int):
        kept, skipped = [], 0
        for chunk in cut_text(text, most):
            if limit < 0 or len(kept) < limit:
                kept.append(chunk)
            else:
                skipped += len(chunk)
        for i, chunk in enumerate(kept, 1):
            yield i, len(kept), chunk, skipped


def chunk_table(papers: DataFrame, key: str = "filename", text: str = "text", most: int = MAX_CHARS, limit: int | None = MAX_CHUNKS) -> DataFrame:
    """key, idx (from 1), total (after the limit), chunk, skipped_chars."""
    if limit is not None and limit < 0:
        raise ValueError("the limit of chunks can't be negative")
    rows = papers.select(F.col(key), F.col(text).alias("__text"))
    short = rows.where((F.length("__text") <= most) & F.lit(limit != 0)).select(key, F.lit(1).alias("idx"), F.lit(1).alias("total"), F.col("__text").alias("chunk"), F.lit(0).cast("long").alias("skipped_chars"))
    cut = Chunks(F.col("__text").outer(), F.lit(most), F.lit(-1 if limit is None else limit))
    return short.union(rows.where(F.length("__text") > most).lateralJoin(cut).select(key, "idx", "total", "chunk", "skipped_chars"))
