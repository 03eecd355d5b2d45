"""The whole run: scan, reuse or extract, describe, summarise, write, derive the indexes."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.operators import layout, ledger, model, render, state, titles
from leafmill.schemas import FIGURES
from leafmill.sources import files, pdf, sinks

LITTLE_TEXT = 500


@dataclass
class Options:
    papers_dir: str = "papers"
    out_dir: str = "output"
    work_dir: str = ".leafmill"
    paper: str | None = None
    combined: bool = False
    max_chunks: int | None = None
    max_pages: int | None = None
    use_cache: bool = True
    clear_cache: bool = False
    figures: bool = True
    max_figures: int = layout.MAX_FIGURES
    prompts: model.Prompts = field(default_factory=model.Prompts)
    model: Callable[[], object] = model.FirstSentences
    backend: pdf.Backend = field(default_factory=pdf.Libraries)


@dataclass
class Report:
    papers: int
    failures: int
    written: list[str]
    crops: int
    little_text: list[str]
    errors: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return int(self.failures > 0)


def extracted(spark: SparkSession, found: DataFrame, o: Options) -> DataFrame:
    """filename, pdf_path, hash, title, text, figures, error of new files; each is parsed once, the result written."""
    work, none = f"{o.work_dir}/run", F.array().cast(FIGURES)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    # One scan of the contents: what titles need of them is found on the way into the parser.
    seen = titles.with_meta(found.select("path", "filename", "hash", "content"))
    parsed = written(pdf.read(seen, o.backend, o.max_pages, o.figures), "parsed")
    rows = titles.with_titles(parsed).select("filename", F.col("path").alias("pdf_path"), "hash", "title", S.clean_pdf_text(F.col("raw_text")).alias("text"), "error")
    if not o.figures:
        return written(rows.withColumn("figures", none), "extracted")
    prims, blocks = pdf.geometry(parsed.where(F.col("error").isNull()))
    regions = written(layout.figures(prims, blocks, o.max_pages, o.max_figures), "regions")
    crops = written(pdf.write_crops(found, regions, o.backend, f"{o.work_dir}/figures"), "crops")
    fig = F.struct("page", "rect", "label", "caption", "png_path", F.lit(None).cast("string").alias("description"))
    listed = regions.join(crops, ["doc_id", "ord"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", fig.alias("fig")))).alias("figs"), F.min_by("crop_error", F.when(F.col("crop_error").isNotNull(), F.col("ord"))).alias("crop_error"))
    joined = rows.join(listed, S.stem(F.col("filename")) == F.col("doc_id"), "left").withColumn("error", F.coalesce("error", "crop_error"))
    return written(joined.withColumn("figures", F.coalesce(F.transform("figs", lambda x: x["fig"]).cast(FIGURES), none)).drop("figs", "doc_id", "crop_error"), "extracted")


def load(spark: SparkSession, o: Options) -> DataFrame:
    """Papers of unchanged files from the state and of all others by extraction; error tells of failed ones."""
    only = files.select_paper(spark, o.papers_dir, o.paper) if o.paper else None
    found = files.pdf_files(spark, o.papers_dir, only)
    folder, options = f"{o.work_dir}/state", state.options_hash(pages=o.max_pages, figures=o.figures, most=o.max_figures)
    if not o.use_cache:
        return extracted(spark, found, o)
    if o.clear_cache:
        state.clear(spark, folder)
    known = state.load(spark, folder, only)
    crops = files.crop_files(spark, f"{o.work_dir}/figures")
    hits, misses = state.split(found, known, options, crops)
    new = extracted(spark, misses, o).withColumn("options_hash", F.lit(options))
    failed = new.where(F.col("error").isNotNull())
    fresh = new.where(F.col("error").isNull())
    if state.append(fresh, folder):
        state.compact(spark, folder)
    stored = state.load(spark, folder, only).where(F.col("options_hash") == options)
    paths = found.select("filename", F.col("path").alias("pdf_path"), "hash")
    papers = stored.join(paths, ["filename", "hash"]).select("filename", "pdf_path", "hash", "title", "text", F.lit(None).cast("string").alias("error"), "figures")
    return papers.unionByName(failed.select(*papers.columns))


def run(spark: SparkSession, o: Options) -> Report:
    loaded = load(spark, o)
    work = f"{o.work_dir}/run"
    # Numbers are taken on the way into the tables; jobs of their own only list what they tell of.
    read = Observation("loaded")
    loaded.observe(read, F.count_if(F.col("error").isNotNull()).alias("failed")).write.mode("overwrite").parquet(f"{work}/loaded")
    loaded = spark.read.schema(loaded.schema).parquet(f"{work}/loaded")
    papers = loaded.where(F.col("error").isNull()).drop("error")
    failures = read.get["failed"]
    errors = [f"extract failed for {r[0]}: {r[1]}" for r in loaded.where(F.col("error").isNotNull()).select("filename", "error").orderBy("filename").limit(100).collect()] if failures else []

    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(table.schema).parquet(f"{work}/{name}")

    crops = files.crop_files(spark, f"{o.work_dir}/figures")
    answers = ledger.Ledger(f"{o.work_dir}/ledger", f"{getattr(o.model, '__qualname__', type(o.model).__name__)} {model.text_model()} {model.vision_model()}") if o.use_cache else None
    done = model.summarized(papers, crops, o.model, o.prompts, o.max_chunks, keep, answers)
    told = Observation("summarized")
    is_little = F.length("text") < LITTLE_TEXT
    counted = done.observe(told, F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(is_little).alias("little"))
    counted.write.mode("overwrite").parquet(f"{work}/summarized")
    done = spark.read.schema(done.schema).parquet(f"{work}/summarized")
    n = told.get["n"]
    failures += told.get["failed"]
    errors += [f"summary failed for {r[0]}: {r[1]}" for r in done.where("status = 'failed'").select("filename", "error").orderBy("filename").limit(100).collect()] if told.get["failed"] else []
    little = [r[0] for r in done.where(is_little).select("filename").orderBy("filename").limit(100).collect()] if told.get["little"] else []
    if o.paper and not n:
        return Report(0, max(failures, 1), [], 0, little, errors)
    there = done.select("filename", F.explode("figures.png_path").alias("path")).join(crops.select("path"), "path", "left_semi")
    done = done.join(there.groupBy("filename").agg(F.collect_set("path").alias("__crops")), "filename", "left")
    existing = F.coalesce("__crops", F.array().cast("array<string>"))
    name = F.concat(S.stem(F.col("filename")), F.lit(".md"))
    docs = done.withColumns({"__name": name, "__main": render.paper_document(existing), "__raw": render.raw_document(existing)})
    main = docs.select(F.col("__name").alias("filename"), F.col("__main").alias("content"))
    raw = docs.where((F.col("text") != "") | (F.size("figures") > 0)).select(F.concat(F.lit("raw/"), "__name").alias("filename"), F.col("__raw").alias("content"))
    copied = sinks.export_crops(done, o.out_dir)
    wrote = [r[0] for r in sinks.write_if_changed(main.union(raw), o.out_dir).collect()]
    docs = files.written_documents(spark, o.out_dir)
    raws = files.written_documents(spark, f"{o.out_dir}/raw").select("filename")
    derived = {render.INDEX: render.index_pieces(docs, raws)} | ({render.COMBINED: render.combined_pieces(docs)} if o.combined else {})
    wrote += [name for name, pieces in derived.items() if sinks.write_pieces(pieces, o.out_dir, name)]
    return Report(n, failures, sorted(wrote), copied, little, errors)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmill")
    p.add_argument("--papers-dir", default="papers")
    p.add_argument("--out-dir", default="output")
    p.add_argument("--paper", metavar="NAME")
    p.add_argument("--combined", action="store_true")
    p.add_argument("--max-chunks", type=int)
    p.add_argument("--max-pages", type=int, default=0)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--no-figures", action="store_true")
    p.add_argument("--max-figures", type=int, default=layout.MAX_FIGURES)
    p.add_argument("--work-dir", default=".leafmill", help="state, crops and run tables; a folder that all executors share")
    p.add_argument("--prompts", default="prompts.json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("leafmill").config("spark.sql.session.timeZone", "UTC").config("spark.speculation", "false").getOrCreate()
    options = Options(
        papers_dir=os.path.abspath(a.papers_dir), out_dir=os.path.abspath(a.out_dir), work_dir=os.path.abspath(a.work_dir), paper=a.paper, combined=a.combined, max_chunks=a.max_chunks, max_pages=a.max_pages or None,
        use_cache=not a.no_cache, clear_cache=a.clear_cache, figures=not a.no_figures, max_figures=a.max_figures, prompts=model.Prompts.from_json(a.prompts), model=model.ChatModel,
    )
    report = run(spark, options)
    for path in report.written:
        print(f"Wrote: {path}")
    for name in report.little_text:
        print(f"[WARN] Very little text in {name}", file=sys.stderr)
    for error in report.errors:
        print(f"[ERROR] {error}", file=sys.stderr)
    if report.failures:
        print(f"[WARN] Failures: {report.failures}", file=sys.stderr)
    return report.exit_code
