"""Model calls over chunks (map), papers (reduce) and figures, with errors as data.

A model is any object with complete(prompts, images) -> list of replies; it is built
once in each worker by a factory. The default needs no network.
"""

from __future__ import annotations

import functools
import os
import sys
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import strings as S

from .chunking import MAX_CHARS, MAX_CHUNKS, chunk_table
from .ledger import Ledger
from .weave import woven

#: The notes that stand for missing results, the default model and service.
NO_VISION = "[No vision interpretation available — caption only]"
NO_TEXT = "_No extractable text in this PDF._"
DEFAULT_MODEL = "google/gemini-3.1-flash-lite"
DEFAULT_URL = "https://openrouter.ai/api/v1"
DEBUG_TRACE = "LEAFMILL_DEBUG_TRACE"


@dataclass(frozen=True)
class Prompts:
    """Templates and limits; from_json() overlays a file's values, a missing or broken file changes nothing."""

    chunk_prompt: str = "Summarise this part of a document in a few points.\n\nTitle: {title}\nPart {idx} of {total}:\n\n{chunk}"
    reduce_prompt: str = "Join these part summaries into one summary in markdown, beginning with a '### TL;DR' list.\n\nTitle: {title}\n\nParts:\n\n{summaries}"
    figure_prompt: str = "Describe this figure so that it can be understood unseen.\n\nTitle: {title}\nFigure: {label}\nCaption: {caption}"
    chunk_max_chars: int = MAX_CHARS
    max_chunks: int = MAX_CHUNKS

    @classmethod
    def from_json(cls, path: str) -> Prompts:
        import json

        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return cls()
        return cls(**{k: v for k, v in found.items() if k in cls.__dataclass_fields__}) if isinstance(found, dict) else cls()


class FirstSentences:
    """Stands in for a model: the first sentence behind the prompt's last blank line."""

    def complete(self, prompts: list[str], images: list[str | None]) -> list[str]:
        return ["- " + p.rsplit("\n\n", 1)[-1].split(". ")[0].strip()[:200] for p in prompts]


@dataclass
class ChatModel:
    """A chat service of the usual kind; asks for its package and key at the first call."""

    model: str = ""
    settings: dict = field(default_factory=dict)

    def _client(self):
        if not os.environ.get("OPENAI_API_KEY"):
            raise RuntimeError("OPENAI_API_KEY is not set")
        try:
            from openai import OpenAI
        except ImportError as e:
            raise RuntimeError("the openai package is not installed") from e
        return _shared(OpenAI, os.environ["OPENAI_API_KEY"], os.environ.get("OPENAI_BASE_URL") or DEFAULT_URL)

    def complete(self, prompts: list[str], images: list[str | None]) -> list[str]:
        client, out = self._client(), []
        for prompt, image in zip(prompts, images, strict=True):
            content = prompt if image is None else [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}]
            reply = client.chat.completions.create(model=self.model or (text_model() if image is None else vision_model()), messages=[{"role": "user", "content": content}], **self.settings)
            out.append(reply.choices[0].message.content)
        return out


@functools.lru_cache(4)
def _shared(kind, key: str, url: str):
    """One client for all calls of a worker."""
    return kind(api_key=key, base_url=url)


def text_model() -> str:
    return os.environ.get("OPENAI_MODEL", DEFAULT_MODEL)


def vision_model() -> str:
    return os.environ.get("OPENAI_VISION_MODEL") or text_model()


def error_text(e: BaseException) -> str:
    """Type and message, or the type alone; with DEBUG_TRACE set, the traceback goes to the worker's error output."""
    if os.environ.get(DEBUG_TRACE, "").strip().lower() not in ("", "0", "false", "no", "off"):
        traceback.print_exception(e, file=sys.stderr)
    return f"{type(e).__name__}: {e}" if str(e).strip() else type(e).__name__


def answered(factory: Callable[[], object]) -> Callable[..., Column]:
    """An Arrow UDF (prompt, image) -> struct(reply, error); a call that fails fails alone."""

    def one(model, prompt, image):
        try:
            reply = model.complete([prompt], [image])[0]
            if reply is None:
                raise ValueError("the model gave no content")
            return reply.strip(), None
        except Exception as e:  # noqa: BLE001  any failure becomes the row's error
            return None, error_text(e)

    @F.pandas_udf("reply string, error string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = None
        for prompts, images in batches:
            model = model or factory()
            pairs = [(None, None) if p is None else one(model, p, i) for p, i in zip(prompts, images.where(images.notna(), None), strict=True)]
            yield pd.DataFrame(pairs, columns=["reply", "error"])

    return call


def told(asked: DataFrame, factory: Callable[[], object], ledger: Ledger | None) -> DataFrame:
    """asked(prompt, image, ...) with __r, a struct of reply and error; with a ledger, no question is paid for twice."""
    if ledger is not None:
        return ledger.answered(asked, factory)
    return asked.withColumn("__r", answered(factory)("prompt", "image"))


def filled(template: str | Column, **values: Column) -> Column:
    """A template with {names} replaced in the given order; what goes in is searched for later names."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def chunk_summaries(papers: DataFrame, factory=FirstSentences, prompts: Prompts | None = None, max_chunks: int | None = None, text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """filename, idx, summary, error of each chunk; a chunk a row, dealt out for parallel calls."""
    prompts = prompts or Prompts()
    limit = prompts.max_chunks if max_chunks is None else max_chunks
    parts = chunk_table(papers, "filename", text, prompts.chunk_max_chars, limit).join(papers.select("filename", "title"), "filename")
    asked = parts.withColumn("prompt", filled(prompts.chunk_prompt, title=F.col("title"), idx=F.col("idx"), total=F.col("total"), chunk=F.col("chunk")))
    dealt = asked.repartition("filename", "idx").withColumn("image", F.lit(None).cast("string"))
    return told(dealt, factory, ledger).select("filename", "idx", F.col("__r.reply").alias("summary"), F.col("__r.error").alias("error"))


def reduced(papers: DataFrame, parts: DataFrame, factory=FirstSentences, prompts: Prompts | None = None, ledger: Ledger | None = None) -> DataFrame:
    """filename, summary_md, error: the part summaries of a paper in order, joined and asked about once."""
    prompts = prompts or Prompts()
    # Chunks of a paper are at most max_chunks rows.
    grouped = parts.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("idx", "summary"))).alias("parts"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("idx"))).alias("failed"))
    joined = papers.select("filename", "title").join(grouped, "filename", "left")
    summaries = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<idx:int,summary:string>>")), lambda p: p["summary"]), "\n\n")
    asked = joined.withColumn("prompt", F.when(F.col("failed").isNull(), filled(prompts.reduce_prompt, title=F.col("title"), summaries=summaries)))
    return told(asked.withColumn("image", F.lit(None).cast("string")), factory, ledger).select("filename", F.col("__r.reply").alias("summary_md"), F.coalesce("failed", "__r.error").alias("error"))


def described(papers: DataFrame, crops: DataFrame, factory=FirstSentences, prompts: Prompts | None = None, ledger: Ledger | None = None) -> DataFrame:
    """papers with figure descriptions, and vision_error, the first failure of each paper.

    crops(path, content): a figure whose png_path isn't there is not asked about.
    """
    prompts = prompts or Prompts()
    flat = papers.select("filename", "title", F.posexplode("figures").alias("pos", "fig"))
    images = crops.select(F.col("path").alias("__path"), F.base64("content").alias("image"))
    asked = flat.join(images, F.col("fig.png_path") == F.col("__path"), "left")
    label, caption = (F.coalesce(S.found(F.col(f"fig.{c}")), F.lit(d)) for c, d in (("label", "unlabeled figure"), ("caption", "(none found)")))
    prompt = F.when(F.col("image").isNotNull(), filled(prompts.figure_prompt, title=F.col("title"), label=label, caption=caption))
    answers = told(asked.withColumn("prompt", prompt), factory, ledger)
    figure = F.col("fig").withField("description", F.coalesce(S.found(F.col("__r.reply")), F.lit(NO_VISION)))
    answers = answers.select("filename", "pos", figure.alias("fig"), F.col("__r.error").alias("error"))
    grouped = answers.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("pos", "fig"))).alias("figs"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("vision_error"))
    figures = F.coalesce(F.transform("figs", lambda x: x["fig"]), F.col("figures"))
    return papers.join(grouped, "filename", "left").withColumn("figures", figures).drop("figs")


def summarized(
    papers: DataFrame, crops: DataFrame, factory=FirstSentences, prompts: Prompts | None = None, max_chunks: int | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, ledger: Ledger | None = None,
) -> DataFrame:
    """papers with figures described, summary_md, status and error; `text` stays as it was.

    keep(table, name) stands behind each step that asks (described, parts, answers): hand in a
    table write, so that no step's plan, calls and all, is read twice. A ledger also spares
    calls over tasks and runs that die, and for equal questions.
    """
    blank = (F.coalesce(F.col("text"), F.lit("")) == "") & (F.coalesce(F.size("figures"), F.lit(0)) <= 0)
    bare = papers.where(blank).withColumn("vision_error", F.lit(None).cast("string"))
    full = keep(described(papers.where(~blank), crops, factory, prompts, ledger), "described")
    asked = full.withColumn("__input", woven(F.coalesce("text", F.lit("")), F.col("figures")))
    parts = keep(chunk_summaries(asked, factory, prompts, max_chunks, "__input", ledger), "parts")
    answers = keep(reduced(full, parts, factory, prompts, ledger), "answers").select("filename", F.col("summary_md").alias("__md"), "error")
    failed = F.concat(F.lit("> **Summary generation failed**: "), F.col("error"))
    done = full.join(answers, "filename", "left").withColumn("summary_md", F.coalesce("__md", failed)).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed")).drop("__md")
    none = bare.withColumn("summary_md", F.lit(NO_TEXT)).withColumn("error", F.lit(None).cast("string")).withColumn("status", F.lit("empty"))
    return done.unionByName(none)

