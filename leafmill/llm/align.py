"""Alignment of two tokenizers' ids by a dictionary of groups.

A text is encoded by A (byte-level BPE, of a space and the text) and by B (sentencepiece,
which adds that space). Where both end a token at the same byte, a group ends: some A ids
and some B ids over the same bytes. Inside a group no other end is shared, so the ids
alone tell which tokens overlap.

Each document gives its distinct groups with their number. The dictionary interns every
distinct group of the corpus with its occurrences and its documents; its links are expanded
once, and times the occurrences they give each id pair's count and each B id's best
partners. The sums that a group contributes go back to the documents by the group. Of the
documents' entries, groups that hold more than one in HOT of them (so at most HOT) are
answered by a broadcast; all others meet the dictionary by a shuffle, where no group has
more than that share.

Both tokenizers start anew at a blank behind a letter, digit or ASCII mark, so a text is the
sum of its parts there, and each distinct part is encoded once per worker while remembered.

Null and empty texts have no tokens, nor have texts that the ids don't spell again (such as
those that hold U+2581). Repeated rows and null ids are documents of their own. Other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, tidy, written
from .tokens import Remembered, slices

CUT = "\x00"
HOT, HOT_CHARS = 4096, 64
STRING = pa.large_string()
NO_PART = 0xFFFFFFFF


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


class Tokenizers:
    """Both libraries, and the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, n = byte_letters(), self.b.get_piece_size()
        names = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "\n")) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the blank which the library adds; of blanks alone, as they stand behind a word."""
        ids = self.b.encode([t[1:] if t.strip(" ") else "a" + t for t in texts], num_threads=1)
        return [x if t.strip(" ") else x[1:] for t, x in zip(texts, ids, strict=True)]


@functools.lru_cache(2)
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def _joined(values: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """One string for each run of values."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(mark, STRING))


class Aligner(Remembered):
    """The groups of texts; pool values are numbers in `groups`, NO_PART for a part that the ids don't spell."""

    def __init__(self, tools: Tokenizers | None = None):
        if tools is not None:
            self.tools = tools
        super().__init__()
        self.groups = pa.array([], STRING)
        self.n_a, self.n_b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        Aligner.__init__(self)

    def pieces(self, texts: pa.Array) -> pa.Array:
        texts = texts.cast(STRING)
        spaced = pc.if_else(pc.equal(texts, pa.scalar("", STRING)), pa.scalar("", STRING), pc.binary_join_element_wise(pa.scalar(" ", STRING), texts, pa.scalar("", STRING)))
        parts = pc.split_pattern(pc.replace_substring_regex(spaced, r"([\pL\pN!-~]) ", rf"\1{CUT} "), CUT)
        odd = pc.match_substring(texts, CUT)
        if not pc.any(odd).as_py():
            return parts
        whole = [[t] if o else p for t, o, p in zip(spaced.to_pylist(), odd.to_pylist(), parts.to_pylist(), strict=True)]
        return pa.array(whole, pa.large_list(STRING))

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tools, texts = self.tools, pieces.to_pylist()
        (a, a_n), (b, b_n) = _flat(tools.encode_a(texts)), _flat(tools.encode_b(texts))
        a_text, b_text = b"".join([tools.a_bytes[i] for i in a.tolist()]), b"".join([tools.b_bytes[i] for i in b.tolist()])
        raw = pieces.cast(pa.large_binary())
        sizes = np.asarray(pc.binary_length(raw)).astype(np.int64)
        a_end, b_end = np.cumsum(tools.a_sizes[a]), np.cumsum(tools.b_sizes[b])
        a_stop, b_stop, stop = np.cumsum(a_n), np.cumsum(b_n), np.cumsum(sizes)
        whole = b"".join(raw.to_pylist())
        if a_text == whole == b_text:
            good = np.ones(len(texts), bool)
        else:
            a_at, b_at = (np.concatenate([[0], x])[np.concatenate([[0], y])] for x, y in ((a_end, a_stop), (b_end, b_stop)))
            good = np.array([a_text[p:q] == t.encode() == b_text[r:s] for t, p, q, r, s in zip(texts, a_at[:-1].tolist(), a_at[1:].tolist(), b_at[:-1].tolist(), b_at[1:].tolist(), strict=True)], bool)
            a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
            a_n, b_n, sizes = np.where(good, a_n, 0), np.where(good, b_n, 0), np.where(good, sizes, 0)
            a_end, b_end, stop = np.cumsum(tools.a_sizes[a]), np.cumsum(tools.b_sizes[b]), np.cumsum(sizes)
        # Places are of all good parts in a row, where both tokenizers' ends meet; every part ends at one.
        _, a_last, b_last = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        number = lambda x: pa.array(x).cast(STRING)
        names = pc.binary_join_element_wise(_joined(number(a), a_last + 1, ","), _joined(number(b), b_last + 1, ","), pa.scalar("|", STRING))
        of_part = np.searchsorted(a_end[a_last], stop, "right") if len(a_last) else np.zeros(len(texts), np.int64)
        count = np.diff(of_part, prepend=0)
        coded = names.dictionary_encode()
        own = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.groups), -1)).astype(np.int64)
        new = np.nonzero(own < 0)[0]
        own[new] = len(self.groups) + np.arange(len(new))
        first = np.zeros(len(coded.dictionary), np.int64)
        index = np.asarray(coded.indices).astype(np.int64)
        first[index[::-1]] = np.arange(len(index))[::-1]
        self.groups = pa.concat_arrays([self.groups, coded.dictionary.take(pa.array(new))])
        self.n_a, self.n_b = np.concatenate([self.n_a, a_size[first[new]]]), np.concatenate([self.n_b, b_size[first[new]]])
        out, sizes = own[index].astype(np.uint32), np.where(good, count, 1)
        if good.all():
            return np.arange(len(texts)), out, sizes
        full = np.full(int(sizes.sum()), NO_PART, np.uint32)
        full[np.repeat(good, sizes)] = out
        return np.arange(len(texts)), full, sizes


ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<string>, counts array<int>"


def encoded(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """A row for each document: its numbers of tokens, groups and links, the hash of its groups in order, and its distinct groups with their counts."""
    a_path, b_path = vocabularies or default_vocabularies()

    def run(batches):
        tool = Aligner(tokenizers_of(a_path, b_path))
        for batch in batches:
            for part in slices(batch, "text"):
                flat, ends = tool.joined(pc.fill_null(part.column("text"), ""))
                n = part.num_rows
                doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
                lost = np.zeros(n, bool)
                lost[doc[flat == NO_PART]] = True
                keep = ~lost[doc]
                flat, doc = flat[keep].astype(np.int64), doc[keep]
                ends = np.cumsum(np.bincount(doc, minlength=n))
                a, b = (np.bincount(doc, x[flat], n).astype(np.int64) for x in (tool.n_a, tool.n_b))
                count = np.diff(ends, prepend=0)
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if k else "" for x, k in zip(_joined(tool.groups.take(pa.array(flat)), ends, ";"), count.tolist(), strict=True)]
                own, times = np.unique(doc * max(len(tool.groups), 1) + flat, return_counts=True)
                bounds = pa.array(np.searchsorted(own, np.arange(n + 1) * max(len(tool.groups), 1)), pa.int32())
                groups = pa.ListArray.from_arrays(bounds, tool.groups.take(pa.array(own % max(len(tool.groups), 1))).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(a), pa.array(b), pa.array(count), pa.array(a + b - count), pa.array(digests, pa.string()), groups, pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), ENCODED)


def links_of(group: str, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids in a group whose bytes overlap, each as often as it occurs."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    out, i, j = [], 0, 0
    a_end, b_end = int(a_sizes[a[0]]), int(b_sizes[b[0]])
    while True:
        out.append((a[i], b[j]))
        step_a, step_b = a_end <= b_end, b_end <= a_end
        if step_a:
            i += 1
            if i == len(a):
                return out
            a_end += int(a_sizes[a[i]])
        if step_b:
            j += 1
            b_end += int(b_sizes[b[j]])


def expanded(dictionary: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """group, freq, docs and a pair (a, b) with the times it is linked inside the group; a row for each distinct pair of each distinct group."""
    a_path, b_path = vocabularies or default_vocabularies()

    def run(batches):
        tools = tokenizers_of(a_path, b_path)
        for batch in batches:
            row, pairs = [], []
            for k, group in enumerate(batch.column("group").to_pylist()):
                own = links_of(group, tools.a_sizes, tools.b_sizes)
                row += [k] * len(own)
                pairs += own
            at, ab = np.array(row, np.int64), np.array(pairs, np.int64).reshape(-1, 2)
            cells, times = np.unique(np.column_stack([at, ab]), axis=0, return_counts=True)
            kept = batch.take(pa.array(cells[:, 0]))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(x.astype(np.int32)) for x in (cells[:, 1], cells[:, 2], times)]], ["group", "freq", "docs", "a", "b", "times"])

    return dictionary.select("group", "freq", "docs").mapInArrow(tidy(run), "group string, freq long, docs long, a int, b int, times int")


def alignment(docs: DataFrame, folder: str, vocabularies: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the documents (with a row number), of the group dictionary (group, freq, docs), and of the id pairs: a, b, links (of the corpus), docs_bound (documents of its groups, a document counted for each), best (none of b's pairs has more links)."""
    rows = written(encoded(docs, vocabularies).withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    entries = rows.select("row", F.explode(F.arrays_zip("groups", "counts")).alias("e")).select("row", F.col("e.groups").alias("group"), F.col("e.counts").alias("n"))
    dictionary = written(entries.groupBy("group").agg(F.sum("n").alias("freq"), F.count("*").alias("docs")), f"{folder}/dictionary")
    links = expanded(dictionary, vocabularies).select("a", "b", (F.col("freq") * F.col("times")).alias("links"), "docs")
    pairs = written(links.groupBy("a", "b").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs_bound")), f"{folder}/counted")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    pairs = written(pairs.join(most, "b").select("a", "b", "links", "docs_bound", (F.col("links") == F.col("most")).alias("best")), f"{folder}/pairs")
    return rows, dictionary, pairs


def aligned(docs: DataFrame, folder: str | None = None, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    folder = folder or shared_dir(docs.sparkSession)
    rows, dictionary, pairs = alignment(docs, folder, vocabularies)
    links = expanded(dictionary, vocabularies).join(pairs.select("a", "b", "links", "best"), ["a", "b"])
    worth = links.groupBy("group").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    worth = written(worth.join(dictionary.select("group", "docs"), "group"), f"{folder}/worth")
    total = worth.agg(F.sum("docs")).first()[0] or 0
    is_hot = (F.col("docs") * HOT > total) & (F.length("group") <= HOT_CHARS)
    hot = worth.where(is_hot).drop("docs")  # at most HOT groups of HOT_CHARS each
    entries = rows.select("row", F.explode(F.arrays_zip("groups", "counts")).alias("e")).select("row", F.col("e.groups").alias("group"), F.col("e.counts").alias("n"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.col("n") * F.col("n_best")).alias("n_best"), F.sum(F.col("n") * F.col("count_sum")).alias("count_sum"))
    common = entries.join(F.broadcast(hot), "group")
    rare = entries.join(F.broadcast(hot.select("group")), "group", "left_anti").join(worth.where(~is_hot).drop("docs"), "group")
    both = sums(common.select("row", "n", "n_best", "count_sum").union(rare.select("row", "n", "n_best", "count_sum")))
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def op11_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
