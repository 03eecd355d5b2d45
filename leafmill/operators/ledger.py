"""One paid call for each distinct question: a table of answers that is asked before the model is.

A question is its model, prompt and picture; its key is their hash. Questions without an
answer in the table are told apart by key, dealt to tasks by key and asked, several at a
time in each task, with a pause and a further try where the failure is one that passes.
Each answer goes at once, a line each, to a journal of the task's own; a task that runs
again, and any later run, reads the journals first, so that no answered question is asked
again, whatever dies. When all are asked the answers become one more part of the table and
their journals go. Failures are data of the run and are not remembered: they are asked
again by the next.

Journals go through `os`, so the folder is one that all executors share as files.
"""

from __future__ import annotations

import glob
import json
import os
import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import shared

ANSWERS = "key string, reply string"
#: Codes of a service that failures pass with, and words in the names of their types.
PASSING_CODES = (408, 409, 425, 429, 500, 502, 503, 504)
PASSING_NAMES = ("RateLimit", "Timeout", "Connection", "InternalServer", "Overloaded")


def passes(e: BaseException) -> bool:
    """Whether a later try may do better."""
    if isinstance(e, (TimeoutError, ConnectionError)):
        return True
    return getattr(e, "status_code", None) in PASSING_CODES or any(x in type(e).__name__ for x in PASSING_NAMES)


@dataclass(frozen=True)
class Patience:
    """Calls at a time in a task, tries of a call, seconds before the second try; each further pause is twice as long."""

    at_once: int = 4
    tries: int = 4
    pause: float = 0.5

    def ask(self, model, prompt: str, image: str | None) -> str:
        for turn in range(self.tries):
            try:
                reply = model.complete([prompt], [image])[0]
                if reply is None:
                    raise ValueError("the model gave no content")
                return reply.strip()
            except Exception as e:  # noqa: BLE001  the last failure is the caller's
                if turn + 1 == self.tries or not passes(e):
                    raise
                time.sleep(self.pause * 2**turn * (0.5 + random.random()))
        raise AssertionError("no try was made")


def _journaled(folder: str) -> dict[str, str]:
    """Answers of earlier attempts; a line that a dying task left unfinished is none."""
    out = {}
    for path in glob.glob(f"{glob.escape(folder)}/*.jsonl"):
        with open(path, encoding="utf-8") as f:
            for line in f:
                try:
                    key, reply = json.loads(line)
                except ValueError:
                    continue
                out[key] = reply
    return out


@dataclass(frozen=True)
class Ledger:
    """Answers under folder, of the model that `model` names; parts: tasks that the questions are dealt to."""

    folder: str
    model: str = ""
    parts: int = 64
    patience: Patience = Patience()

    def key(self, prompt: Column, image: Column) -> Column:
        """Null for a question that isn't one. Lengths stand between, so that no two questions are written alike."""
        picture = F.coalesce(F.sha2(image.cast("binary"), 256), F.lit("-"))
        return F.when(prompt.isNotNull(), F.sha2(F.concat_ws("|", F.lit(str(len(self.model)) + self.model), picture, prompt).cast("binary"), 256))

    def table(self, spark: SparkSession) -> DataFrame:
        """key, reply of all answers."""
        path = f"{self.folder}/answers"
        parts = [f"{path}/{n}" for n in shared.names(spark, path) if shared.names(spark, f"{path}/{n}").count("_SUCCESS")]
        return spark.read.schema(ANSWERS + ", error string").parquet(*parts).where("reply is not null").select("key", "reply") if parts else spark.createDataFrame([], ANSWERS)

    def answered(self, asked: DataFrame, factory: Callable[[], object]) -> DataFrame:
        """asked(prompt, image, ...) with __r, a struct of reply and error; both null without a prompt."""
        spark = asked.sparkSession
        keyed = asked.withColumn("__key", self.key(F.col("prompt"), F.col("image")))
        open_ = keyed.where(F.col("__key").isNotNull()).select(F.col("__key").alias("key"), "prompt", F.col("image").cast("string").alias("image"))
        open_ = open_.join(self.table(spark).select("key"), "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"), F.first("image").alias("image"))
        name = uuid.uuid4().hex
        path = f"{self.folder}/answers/{name}"
        open_.repartition(self.parts, "key").mapInPandas(self._asker(factory), ANSWERS + ", error string").write.parquet(path)
        for part in range(self.parts):
            self._drop(part)
        failed = spark.read.schema(ANSWERS + ", error string").parquet(path).where("error is not null").select("key", F.lit(None).cast("string").alias("reply"), "error")
        answers = self.table(spark).dropDuplicates(["key"]).withColumn("error", F.lit(None).cast("string")).union(failed)
        told = answers.select(F.col("key").alias("__key"), F.struct("reply", "error").alias("__r"))
        return keyed.join(told, "__key", "left").drop("__key")

    def _journals(self, part: int) -> str:
        return os.path.join(self.folder.removeprefix("file://"), "journals", f"{self.parts}", f"{part}")

    def _drop(self, part: int) -> None:
        for path in glob.glob(f"{glob.escape(self._journals(part))}/*.jsonl"):
            os.remove(path)

    def _asker(self, factory):
        def run(batches):
            part = TaskContext.get().partitionId()
            folder = self._journals(part)
            os.makedirs(folder, exist_ok=True)
            known, model, journal = _journaled(folder), None, None
            with ThreadPoolExecutor(self.patience.at_once) as pool:
                for rows in batches:
                    rows = rows.where(rows.notna(), None)
                    new = [r for r in rows.itertuples(index=False) if r.key not in known]
                    if new and model is None:
                        model, journal = factory(), open(os.path.join(folder, f"{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")
                    failed = {}
                    # A few at a time are in hand; each answer is on disk before the next is waited for.
                    for a in range(0, len(new), self.patience.at_once):
                        some = new[a : a + self.patience.at_once]
                        for r, call in zip(some, [pool.submit(self.patience.ask, model, r.prompt, r.image) for r in some], strict=True):
                            try:
                                known[r.key] = call.result()
                            except Exception as e:  # noqa: BLE001  any failure becomes the row's error
                                from leafmill.operators.model import error_text

                                failed[r.key] = error_text(e)
                                continue
                            journal.write(json.dumps([r.key, known[r.key]]) + "\n")
                            journal.flush()
                            os.fsync(journal.fileno())
                    yield pd.DataFrame({"key": rows["key"], "reply": [known.get(k) for k in rows["key"]], "error": [failed.get(k) for k in rows["key"]]})
            if journal:
                journal.close()

        return run
