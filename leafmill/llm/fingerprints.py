"""Document fingerprints by SpotSigs (DataFrame and SQL functions only).

A signature is a common word (the anchor) with the chain of the next CHAIN content
words, common words between them skipped. Where common words are rare (lists, tables), a
content word with GAP content words right after it is an anchor too. A text's fingerprint
is its sorted set of signatures, eight hex digits each. A text with no such chain takes
each word as an anchor with the words that follow (fewer near the end), so any text with
a word has a signature. Two fingerprints are compared by Jaccard; near_pairs() finds all alike
ones of a table by partitions of set length, and computes Jaccard only where lengths allow it.

Null text is the empty text; the empty text has the empty fingerprint, which is like
another empty one (1) and unlike all others (0). Rows that repeat a doc_id are put in
order by their text. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound

from .common import documents, quantile_cuts, range_of, shuffle_parts

CHAIN, GAP = 2, 3
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was with be as by this are at an from or which "
    "de la le et les des en un une que qui pour dans sur avec au du par pas il elle ou ne se "
    "der die und den von zu das mit ist ein eine dem des nicht auf im sich auch als "
    "el los las del y por con para no es al su lo como o"
).split()


def _spot(*words: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(" ", *words).cast("binary")), 1, 8)


def signature_set(text: Column) -> Column:
    """Sorted distinct signatures of a text, each eight hex digits; every word is looked at a fixed number of times."""
    none = F.array().cast("array<string>")

    def around(ws: Column, at: Column, p: Column, k: Column) -> Column:
        """Signatures of the content word in place p, the k-th (from 0), and of the common words right before it."""
        one, two = F.get(at, k + 1), F.get(at, k + 2)
        ahead = F.when(k == 0, -1).otherwise(F.get(at, k - 1))
        common = F.transform(F.slice(ws, ahead + 2, p - ahead - 1), lambda c: _spot(c, F.get(ws, p), F.get(ws, one)))
        dense = F.array(_spot(F.get(ws, p), F.get(ws, one), F.get(ws, two)))
        return F.concat(F.when((p - ahead > 1) & one.isNotNull(), common).otherwise(none), F.when(F.get(at, k + GAP) == p + GAP, dense).otherwise(none))

    def plain(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: _spot(w, F.coalesce(F.get(ws, i + 1), F.lit("")), F.coalesce(F.get(ws, i + 2), F.lit(""))))

    def both(ws: Column) -> Column:
        at = F.filter(F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(ws, i).isin(ANCHORS))
        spots = bound(at, lambda places: F.flatten(F.transform(places, lambda p, k: around(ws, places, p, k))))
        return bound(spots, lambda found: F.when(F.size(found) > 0, found).otherwise(plain(ws)))

    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(bound(words, both)))


def as_string(signatures: Column) -> Column:
    return F.array_join(signatures, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones."""
    shared = bound(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared).cast("double")


def near_pairs(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """id_a, id_b, jaccard of representatives of equal fingerprints; membership stays with the caller's groups.

    Sets are partitioned by length in steps of 1/at_least, so a set meets its own and the
    next partition only; within one, pairs meet on the rarest signatures (as many as two
    sets this alike can't all miss), and Jaccard is computed where lengths and the place
    of the first common signature still allow it.
    """
    sets = docs.select("doc_id", signature_set(F.coalesce(F.col("text"), F.lit(""))).alias("sigs")).where(F.size("sigs") > 0)
    reps = sets.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs"))
    spread = reps.select("id", "n", F.explode("sigs").alias("sig"))
    counts = spread.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = spread.join(counts, "sig").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("order"), F.first("n").alias("n"))
    prefix = F.col("n") - F.ceil(F.col("n") * at_least) + 1
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / at_least)))
    keys = ranked.select("id", "n", step.alias("part"), F.posexplode(F.slice("order", 1, prefix.cast("int"))).alias("at", "key")).select("id", "n", "part", "at", F.col("key.sig").alias("sig"))
    low = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    high = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), "sig", "part")
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = (F.col("na") + F.col("nb")) * (at_least / (1 + at_least))
    found = low.join(high, ["part", "sig"]).where(order & (F.col("na") >= F.col("nb") * at_least) & (room >= need - 1e-9)).select("a", "b").distinct()
    full = reps.select("id", "sigs")
    compared = found.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    return compared.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), likeness(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= at_least)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part, halo, doc_id, text: within a part, order by (halo, doc_id desc, text) puts each row before its next.

    The order is by descending doc_id and wraps round.

    Rows go to ranges of ids cut at quantiles, one exchange of the texts. A range's last
    row needs the first row of the range below: ids at the top of a range (one per range)
    are read from the id column beforehand, and their rows go to both ranges.
    """
    parts = parts or 4 * shuffle_parts(docs.sparkSession)
    cuts = quantile_cuts(docs, "doc_id", min(parts, 512))
    ranged = docs.select(range_of(F.col("doc_id"), cuts).alias("part"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tops = {r[0]: r[1] for r in ranged.groupBy("part").agg(F.max("doc_id")).collect()}  # 512 rows at most
    down = sorted(tops, reverse=True)
    own = F.struct(F.col("part"), F.lit(False).alias("halo"))
    homes = F.array(own)
    if down:
        # The first range's top closes the ring for the last range.
        above = F.create_map(*[F.lit(x) for i, p in enumerate(down) for x in (p, down[i - 1])])
        at_top = F.col("doc_id").isin([t for t in tops.values() if t is not None])
        if None in tops.values():
            at_top = at_top | F.col("doc_id").isNull()
        homes = F.when(at_top, F.array(own, F.struct(above[F.col("part")].alias("part"), F.lit(True).alias("halo")))).otherwise(homes)
    return ranged.withColumn("home", F.explode(homes)).select(F.col("home.part").alias("part"), F.col("home.halo").alias("halo"), "doc_id", "text").repartition("part")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    window = Window.partitionBy("part").orderBy(F.col("halo"), F.col("doc_id").desc(), F.col("text"))
    own = with_next(docs).withColumn("sigs", signature_set(F.col("text")))
    rows = own.withColumn("after", F.lead(F.struct("text", "sigs")).over(window)).where(~F.col("halo"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("after.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", F.col("after.sigs").alias("next_sigs"), edited.alias("edited"))
    rows = rows.withColumn("edited_sigs", signature_set(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sigs")).alias("fingerprint"),
        as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


_COMMON = ", ".join(f"'{w}'" for w in ANCHORS)
OP2_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), ring AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM docs
), pairs AS (
  SELECT *, left(t, n - n // 2) || left(after, n // 2) AS edited, lead(doc_id) OVER (ORDER BY doc_id DESC) AS next_id FROM ring
), texts AS (
  SELECT doc_id, 0 AS which, t FROM pairs UNION ALL SELECT doc_id, 1, edited FROM pairs
), words AS (
  SELECT doc_id, which, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM texts
), one AS (
  SELECT doc_id, which, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words
), flagged AS (
  SELECT *, w NOT IN ({_COMMON}) AS content FROM one
), ranked AS (
  SELECT *, count(*) FILTER (content) OVER (PARTITION BY doc_id, which ORDER BY i) AS k FROM flagged
), contents AS (
  SELECT doc_id, which, k, i, w, lead(w, 1) OVER c AS w1, lead(w, 2) OVER c AS w2, lead(i, {GAP}) OVER c AS far FROM ranked WHERE content WINDOW c AS (PARTITION BY doc_id, which ORDER BY i)
), spots AS (
  SELECT doc_id, which, w || ' ' || w1 || ' ' || w2 AS s FROM contents WHERE far = i + {GAP}
  UNION ALL
  SELECT r.doc_id, r.which, r.w || ' ' || c.w || ' ' || c.w1 FROM ranked r JOIN contents c ON r.doc_id = c.doc_id AND r.which = c.which AND r.k + 1 = c.k WHERE NOT r.content AND c.w1 IS NOT NULL
), plain AS (
  SELECT doc_id, which, w || ' ' || coalesce(lead(w, 1) OVER p, '') || ' ' || coalesce(lead(w, 2) OVER p, '') AS s FROM one WINDOW p AS (PARTITION BY doc_id, which ORDER BY i)
), every AS (
  SELECT * FROM spots UNION ALL SELECT plain.* FROM plain ANTI JOIN spots ON plain.doc_id = spots.doc_id AND plain.which = spots.which
), sets AS (
  SELECT doc_id, which, list(DISTINCT left(md5(s), 8)) AS sigs FROM every GROUP BY 1, 2
), full_sets AS (
  SELECT t.doc_id, t.which, coalesce(sigs, []) AS sigs FROM texts t LEFT JOIN sets s ON t.doc_id = s.doc_id AND t.which = s.which
), met AS (
  SELECT p.doc_id, p.n, p.edited, a.sigs AS a, b.sigs AS b, c.sigs AS c, len(list_intersect(a.sigs, b.sigs)) AS ab, len(list_intersect(a.sigs, c.sigs)) AS ac
  FROM pairs p JOIN full_sets a ON a.doc_id = p.doc_id AND a.which = 0 JOIN full_sets b ON b.doc_id = p.doc_id AND b.which = 1
  JOIN full_sets c ON c.which = 0 AND c.doc_id = coalesce(p.next_id, (SELECT max(doc_id) FROM pairs))
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(list_sort(a), '') AS fingerprint, array_to_string(list_sort(b), '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / (len(a) + len(b) - ab) END AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / (len(a) + len(c) - ac) END AS near_next
FROM met
"""
