"""Repeated passages, located by automata and removed but for their first document.

A window of WINDOW words is a repeat in a document if the same words also start in a
document with a smaller doc_id; the words of repeats go.

Every window has one anchor, the least hash among its phrases of PHRASE words, and
windows with the same words have the same anchor. An anchor seen in two documents is
a recurring passage. The phrases of recurring anchors are compiled into Aho-Corasick
automata over words, sharded by the first document that holds the phrase (the phrases of
one document are dealt over several shards where they are more than SHARD_PHRASES); a document
goes to the shards of its own anchors, where the automaton locates every occurrence and
so confirms the phrases word by word. The windows around them are compared by 64-bit
hashes with the least doc_id of each. A shard with much text is dealt out over several
automata, so a passage that a third of all documents hold is no single task.

Documents with the same words as an earlier one are settled by a digest of all words.
Null text has no words. A null doc_id is neither smaller nor larger than another: such a
row keeps all words and marks none. Rows that repeat a doc_id don't mark each other.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, every_column, fresh, mapped, shared_dir, tidy, written
from .links import MOST_BROADCAST, only
from .tokens import slices
from .words import Words, digest, runs

WINDOW, PHRASE = 50, 26
SHARD_PHRASES = 20_000
SHARD_BYTES = 16 << 20
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes, and for each window the place of its anchor among them."""
    phrases = runs(hashes, PHRASE)
    span = WINDOW - PHRASE + 1
    if len(phrases) < span:
        return phrases, np.zeros(0, np.int64)
    out = []
    view = np.lib.stride_tricks.sliding_window_view(phrases, span)
    for a in range(0, len(view), 1 << 16):
        out.append(view[a : a + (1 << 16)].argmin(axis=1) + np.arange(a, min(a + (1 << 16), len(view))))
    return phrases, np.concatenate(out)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, digest (d1, d2), sha256 of all words, distinct anchors."""

    def run(batches):
        from hashlib import sha256

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = words.of(i)
                    phrases, at = anchors(own)
                    rows.append((len(own), *digest(own), sha256(b" ".join((text or "").encode().split())).digest(), np.unique(phrases[at]).view(np.int64)))
                n, d1, d2, sha, found = zip(*rows, strict=True)
                sizes = np.cumsum([0, *[len(x) for x in found]])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha, pa.binary()), lists], ["doc_id", "n_words", "d1", "d2", "sha", "anchors"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_words long, d1 long, d2 long, sha binary, anchors array<long>")


def compiled(phrases: list[tuple[bytes, int]]):
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for ids, name in phrases:
        automaton.add_word(tuple(np.frombuffer(ids, "<u4").tolist()), name)
    automaton.make_automaton()
    return automaton


def word_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype("<u4")


def located(automaton, hashes: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """For each phrase of a document whether the automaton holds it."""
    out = np.zeros(len(phrases), bool)
    if len(phrases) and len(automaton):
        names = phrases.view(np.int64)
        for end, name in automaton.iter(tuple(word_ids(hashes).tolist())):
            at = end - PHRASE + 1
            if names[at] == name:
                out[at] = True
    return out


def repeated_windows(docs: DataFrame, marks: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(d1, d2, first) of long texts; texts with recurring anchors; (doc_id, d1, places) of their repeats."""
    long = marks.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    firsts = written(long.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.first("anchors").alias("anchors")), f"{folder}/firsts")
    spread = firsts.select(F.col("first").alias("doc_id"), "d1", F.explode("anchors").alias("anchor"))
    ends = spread.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last")
    # Written, so that Spark can split the join at an anchor that very many documents hold.
    ends = written(ends.select("anchor", "home"), f"{folder}/ends")
    shards = max(1, -(-ends.count() // SHARD_PHRASES))
    rich = ends.groupBy("home").agg(F.ceil(F.count("*") / SHARD_PHRASES).cast("int").alias("split")).where("split > 1")
    rich = written(rich, f"{folder}/rich")
    if rich.count() <= MOST_BROADCAST:
        rich = F.broadcast(rich)
    shard = F.pmod(F.xxhash64("home", F.coalesce(F.pmod(F.xxhash64("anchor"), F.col("split")), F.lit(0))), F.lit(shards)).cast("int")
    hits = spread.join(ends, "anchor").join(rich, "home", "left").select("doc_id", "d1", "anchor", "home", shard.alias("shard"))
    hits = written(hits, f"{folder}/hits")
    lists = hits.groupBy("doc_id", "d1").agg(F.collect_set("shard").alias("shards"), F.collect_set(F.when(F.col("home") == F.col("doc_id"), F.col("anchor"))).alias("own"))
    ids = written(hits.select("doc_id").distinct(), f"{folder}/ids")

    def name(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([digest(words.of(i))[0] for i in range(part.num_rows)], pa.int64())], ["doc_id", "text", "d1"])

    held = only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), ids, "doc_id")
    texts = written(held.mapInArrow(tidy(name), "doc_id long, text string, d1 long").dropDuplicates(["doc_id", "d1"]).join(lists, ["doc_id", "d1"]), f"{folder}/texts")

    def phrases_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, out = Words(part.column("text")), []
                for i, (doc_id, own) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("own").to_pylist(), strict=True)):
                    phrases = runs(words.of(i), PHRASE)
                    where = np.nonzero(np.isin(phrases, np.array(own, np.int64).view(np.uint64)))[0]
                    names, at = np.unique(phrases[where], return_index=True)
                    ids = word_ids(words.of(i))
                    out += [(doc_id, n, ids[k : k + PHRASE].tobytes()) for n, k in zip(names.view(np.int64).tolist(), where[at].tolist(), strict=True)]
                home, names, ids = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(names, pa.int64()), pa.array(ids, pa.binary())], ["home", "anchor", "ids"])

    routed = texts.select("doc_id", "d1", "text", F.explode("shards").alias("shard"))
    deals = written(routed.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / SHARD_BYTES).cast("int").alias("deals")), f"{folder}/deals")
    salted = routed.join(deals, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "d1"), F.col("deals")).cast("int").alias("deal"), "doc_id", "d1", "text")
    phrases = texts.where(F.size("own") > 0).select("doc_id", "text", "own").mapInArrow(tidy(phrases_of), "home long, anchor long, ids binary")
    phrases = phrases.join(rich, "home", "left").select(shard.alias("shard"), F.col("anchor").alias("name"), "ids")
    copies = phrases.join(deals, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "name", "ids")

    def locate(rows: pa.Table, keys: pa.Table) -> pa.Table:
        automaton = compiled(list(zip(keys.column("ids").to_pylist(), keys.column("name").to_pylist(), strict=True)))
        out = []
        for batch in rows.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                for i, (doc_id, d1) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("d1").to_pylist(), strict=True)):
                    own = words.of(i)
                    phrases, at = anchors(own)
                    starts = np.nonzero(located(automaton, own, phrases)[at])[0]
                    if not len(starts):
                        continue
                    window = runs(own, WINDOW)[starts].view(np.int64)
                    new = np.concatenate([[True], (np.diff(starts) > 1) | (window[1:] != window[:-1])])
                    head = np.nonzero(new)[0]
                    sizes = np.diff(np.append(head, len(starts)))
                    order = np.argsort(window[head], kind="stable")
                    names, first = np.unique(window[head][order], return_index=True)
                    n, place = len(names), (starts[head] << 32) + sizes
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order]))
                    out.append(pa.table({"w": names, "doc_id": np.full(n, doc_id), "d1": np.full(n, d1), "places": lists}, schema=WINDOWS))
        return pa.concat_tables(out) if out else WINDOWS.empty_table()

    grouped = salted.groupBy("shard", "deal").cogroup(copies.groupBy("shard", "deal"))
    found = written(grouped.applyInArrow(locate, "w long, doc_id long, d1 long, places array<long>"), f"{folder}/windows")
    # Written, so that both sides of the join are plain exchanges and Spark can split a window that very many documents hold.
    least = found.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = written(least.select("w", "least"), f"{folder}/least")
    later = written(found.join(least, "w").where("doc_id > least").select("doc_id", "d1", "places"), f"{folder}/later")
    repeats = later.groupBy("doc_id", "d1").agg(F.flatten(F.collect_list("places")).alias("places"))
    return firsts.select("d1", "d2", "first"), texts.select("doc_id", "d1", "text"), repeats


WINDOWS = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("places", pa.list_(pa.int64()))])


def without_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d1, n_words, n_removed, sha) of every row; (doc_id, d1, kept) of the rows cut in part."""
    folder = shared_dir(docs.sparkSession)
    marks = written(marked(docs), f"{folder}/marks")
    firsts, texts, repeats = repeated_windows(docs, marks, folder)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    places = np.array(places, np.int64)
                    start = places >> 32
                    np.add.at(change, start, 1)
                    np.add.at(change, start + (places & 0xFFFFFFFF) - 1 + WINDOW, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    rows.append((int((~stay).sum()), b" ".join(compress(words, stay.tolist())).decode()))
                n, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d1"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "d1", "n_cut", "kept"])

    parts = written(texts.join(repeats, ["doc_id", "d1"]).select("doc_id", "d1", "text", "places").mapInArrow(tidy(cut), "doc_id long, d1 long, n_cut long, kept string"), f"{folder}/cut")
    short = parts.select("doc_id", "d1", "n_cut", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha"))
    rows = marks.select("doc_id", "n_words", "d1", "d2", "sha").join(firsts, ["d1", "d2"], "left").join(short, ["doc_id", "d1"], "left")
    copy = (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull() & (F.col("first") < F.col("doc_id"))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0)))
    sha = F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha"))))
    return rows.select("doc_id", "d1", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256")), parts.select("doc_id", "d1", "kept")


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs with the words of repeats gone from `text` (kept words joined by a space); other texts stay as they are."""
    folder = shared_dir(docs.sparkSession)
    rows, parts = without_repeats(docs)
    d1, gone, kept = (fresh(docs, x) for x in ("d1", "gone", "kept"))
    changed = written(rows.where("n_removed > 0").select("doc_id", F.col("d1").alias(d1), F.lit(True).alias(gone)).distinct(), f"{folder}/changed")
    ids = written(changed.select("doc_id").distinct(), f"{folder}/changed_ids")

    def name(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([digest(words.of(i))[0] for i in range(part.num_rows)], pa.int64())], [*part.schema.names, f"c{part.num_columns}"])

    named = mapped(only(docs, ids, "doc_id"), name, [T.StructField(d1, T.LongType())])
    cut = named.join(changed, ["doc_id", d1], "left").join(parts.select("doc_id", F.col("d1").alias(d1), F.col("kept").alias(kept)), ["doc_id", d1], "left")
    text = F.when(F.col(gone), F.coalesce(kept, F.lit(""))).otherwise(F.col("text"))
    return only(docs, ids, "doc_id", "left_anti").union(cut.withColumn("text", text).select(every_column(docs)))


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))[0].select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i + 49], ' '))})) AS x FROM split WHERE len(w) >= 50
), least AS (
  SELECT x.h AS h, min(doc_id) AS first FROM windows GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(x.i, x.i + 50)) AS i FROM windows JOIN least ON x.h = h WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'word': w[i]})) AS x FROM split
), kept AS (
  SELECT words.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = x.i WHERE gone.doc_id IS NULL GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(len(s.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
