"""Figure blocks woven into a text behind the lines that mention their captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import strings as S


def figure_label(fig: Column) -> Column:
    return S.rstrip_chars(F.coalesce(S.found(fig["label"]), F.lit("Figure")), ": .")


def extra_caption(fig: Column) -> Column:
    """The caption, unless it is empty or no more than the label."""
    return F.when(~fig["caption"].eqNullSafe(fig["label"]), S.found(fig["caption"]))


def figure_block(fig: Column) -> Column:
    """[label (page n)] caption, and the description on the next line."""
    head = F.concat(F.lit("["), figure_label(fig), F.lit(" (page "), (fig["page"] + 1).cast("string"), F.lit(")]"))
    return F.concat(F.concat_ws(" ", head, extra_caption(fig)), F.coalesce(F.concat(F.lit("\n"), S.found(fig["description"])), F.lit("")))


def _anchor(text: Column, fig: Column) -> Column:
    """Characters before the end of the line that first holds the caption, or else the label; null if none does."""
    def end_of_line(mention: Column) -> Column:
        at = F.call_function("locate", mention, text)
        line_end = F.call_function("locate", F.lit("\n"), text, at)
        return F.when((mention != "") & (at > 0), F.when(line_end > 0, line_end - 1).otherwise(F.length(text)))

    return F.coalesce(end_of_line(fig["caption"]), end_of_line(fig["label"]))


def woven(text: Column, figures: Column, block: Callable[[Column], Column] = figure_block) -> Column:
    """Blocks at their anchors in figure order; those without an anchor at the end."""
    marks = F.transform(figures, lambda f: F.struct(_anchor(text, f).alias("at"), block(f).alias("block")))

    def build(marked: Column) -> Column:
        anchors = F.array_sort(F.array_distinct(F.filter(F.transform(marked, lambda m: m["at"]), lambda a: a.isNotNull())))
        start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, a: Column) -> Column:
            here = F.transform(F.filter(marked, lambda m: m["at"] == a), lambda m: F.concat(F.lit("\n\n"), m["block"]))
            part = F.concat(F.substring(text, acc["done"] + 1, a - acc["done"]), F.array_join(here, ""))
            return F.struct(a.alias("done"), F.array_append(acc["out"], part).alias("out"))

        body = F.aggregate(anchors, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["done"] + 1, F.length(text))))
        rest = F.transform(F.filter(marked, lambda m: m["at"].isNull()), lambda m: F.concat(F.lit("\n\n"), m["block"]))
        return F.concat(body, F.array_join(rest, ""))

    return F.when(F.coalesce(F.size(figures), F.lit(0)) > 0, F.transform(F.array(marks), build)[0]).otherwise(text)
