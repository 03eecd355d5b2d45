"""Mixed timestamps to UTC, by arithmetic on byte matrices.

The texts of a batch, stripped and padded to WIDTH bytes, are the rows of a matrix. A
layout is a mask over its columns; digits become numbers by columns, dates days by the
civil-day formula, and wall times find their offset by binary search among the changes of
their zone. The changes come from the zone database, for the zones that occur and that it
knows, so what is broadcast is bounded by the database: about 600 zones, some 200 changes each.

A stamp with slashes that only one order of day and month allows votes for it in its source.
Votes are summed by source; only stamps that both orders allow, with different dates, meet
the sources that one order wins, SALTS ways, so that a source with a third of the rows is
many tasks' work. Nothing of the table goes through the driver.

Null or empty text, impossible and other stamps are bad: null time, no vote. So is a stamp
that needs a zone where that is null or unknown. A null source is a source like others.
Null ids and repeated rows are rows like others; other columns pass through.
"""

from __future__ import annotations

import functools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import every_column, fresh, mapped, shared_dir, written

#: The layouts of dates (digits of year, month and day, letters of a month's name), and what can follow one.
LAYOUTS = ("yyyy-mm-dd", "yyyymmdd", "dd.mm.yyyy", "dd bbb yyyy", "dd/mm/yyyy")
SLASHED = "dd/mm/yyyy"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WIDTH = len("dd bbb yyyy hh:mm:ss AM +hh:mm")
BLANKS = " \t\n\x0b\x0c\r"
SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
BAD, EPOCH, PLAIN, OPEN = range(4)
SALTS = 128
#: Days between the times at which a zone's offset is looked up to find its changes.
STEP = 5


@functools.lru_cache(700)
def changes(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the years 2000 to 2099: wall times at which each change of offset begins and ends to count, and the offsets before, between and after; microseconds."""
    place, zero = ZoneInfo(zone), datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(second: int) -> int:
        return round((zero + timedelta(seconds=second)).astimezone(place).utcoffset().total_seconds())

    first, last = (int((datetime(y, m, d, tzinfo=timezone.utc) - zero).total_seconds()) for y, m, d in ((1999, 12, 25), (2100, 1, 7)))
    at, offsets = [], [offset(first)]
    for low in range(first, last, STEP * 86400):
        high = low + STEP * 86400
        while offset(high) != offsets[-1]:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
            at.append(b)
            offsets.append(offset(b))
            low = b
    when, own = np.array(at, np.int64), np.array(offsets, np.int64)
    both = when[:, None] + np.stack([own[:-1], own[1:]], axis=1) if len(when) else np.zeros((0, 2), np.int64)
    return both.min(axis=1) * SECOND, both.max(axis=1) * SECOND, own * SECOND


def to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """UTC of wall times, and whether a change skips or repeats them; those take the offset before it."""
    begins, ends, offsets = table
    k = np.searchsorted(ends, wall, "right")
    unsure = np.zeros(len(wall), bool)
    inside = k < len(begins)
    unsure[inside] = wall[inside] >= begins[k[inside]]
    return wall - offsets[k], unsure


def civil_days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01, and whether there is such a day."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    real = (m >= 1) & (m <= 12) & (d >= 1) & (d <= most)
    years = y - (m <= 2)
    within = (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return 365 * years + years // 4 - years // 100 + years // 400 + within - 719468, real


def matrix(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Stripped texts as rows of WIDTH + 1 bytes, zeros behind them, and their lengths; longer texts have a length over WIDTH."""
    bare = pc.utf8_trim(pc.fill_null(texts, "").cast(pa.large_string()), BLANKS).cast(pa.large_binary())
    offsets = np.frombuffer(bare.buffers()[1], np.int64)[bare.offset : bare.offset + len(bare) + 1]
    raw = bare.buffers()[2]
    data = np.concatenate([np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8), np.zeros(1, np.uint8)])
    sizes = np.diff(offsets)
    at = np.minimum(offsets[:-1, None] + np.arange(WIDTH + 1), len(data) - 1)
    return np.where(np.arange(WIDTH + 1) < sizes[:, None], data[at], 0), np.minimum(sizes, WIDTH + 1)


def fits(rows: np.ndarray, layout: str) -> np.ndarray:
    """Whether each row begins with the layout; names of months are looked at later."""
    own = rows[:, : len(layout)]
    number = np.array([c in "ymdh" for c in layout])
    name = np.array([c == "b" for c in layout])
    return np.where(number, (own >= 48) & (own <= 57), name | (own == np.frombuffer(layout.encode(), np.uint8))).all(axis=1)


def number(rows: np.ndarray, columns: list[int]) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for c in columns:
        out = out * 10 + rows[:, c] - 48
    return out


def places(layout: str, letter: str) -> list[int]:
    return [i for i, c in enumerate(layout) if c == letter]


def time_of_day(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of what follows the dates: microseconds of the day, whether all of it is possible, whether an offset is given, and the offset."""
    n, at = len(rows), np.arange(len(rows))
    padded = np.concatenate([rows, np.zeros((n, 8), np.uint8)], axis=1)
    there, good = sizes > 0, np.isin(rows[:, 0], (32, 84)) & fits(rows[:, 1:], "hh:hh")
    hour, minute = number(rows, [1, 2]), number(rows, [4, 5])
    full = fits(rows[:, 6:], ":hh")
    second = np.where(full, number(rows, [7, 8]), 0)
    place = np.where(full, 9, 6)
    gap = padded[at, place] == 32
    half, m = padded[at, place + gap], padded[at, place + gap + 1]
    named = ((half == 65) | (half == 80)) & (m == 77)
    place = np.where(named, place + gap + 2, place)
    good &= np.where(named, (hour >= 1) & (hour <= 12), hour <= 23) & (minute <= 59) & (second <= 59)
    hour = np.where(named, hour % 12 + np.where(half == 80, 12, 0), hour)
    gap = padded[at, place] == 32
    tail = np.take_along_axis(padded, np.minimum((place + gap)[:, None] + np.arange(7), padded.shape[1] - 1), axis=1)
    zulu = tail[:, 0] == 90
    signed = np.isin(tail[:, 0], (43, 45)) & fits(tail[:, 1:], "hh")
    colon = tail[:, 3] == 58
    minutes = np.where(colon[:, None], tail[:, 4:6], tail[:, 3:5])
    signed &= fits(minutes, "hh")
    away, rest = number(tail, [1, 2]), number(minutes, [0, 1])
    good &= ~signed | ((away <= 14) & (rest <= 59))
    place = np.where(zulu, place + gap + 1, np.where(signed, place + gap + 5 + colon, place))
    offset = np.where(signed, (away * 60 + rest) * np.where(tail[:, 0] == 45, -1, 1) * MINUTE, 0)
    good &= place == sizes
    return np.where(there, ((hour * 60 + minute) * 60 + second) * SECOND, 0), good | ~there, there & (zulu | signed), offset


def parsed(texts: pa.Array, zones: pa.Array, tables: dict[str, tuple]) -> dict[str, np.ndarray]:
    """For each stamp: state, vote (1 day first, 2 month first), and for both orders (alike without slashes) UTC and whether the wall time is skipped or repeated."""
    rows, sizes = matrix(texts)
    n = len(rows)
    digits = (rows[:, :13] >= 48) & (rows[:, :13] <= 57)
    seconds, millis = (sizes == 10) & digits[:, :10].all(axis=1), (sizes == 13) & digits.all(axis=1)
    y, a, b, width = (np.zeros(n, np.int64) for _ in range(4))  # a, b: month and day, or what stands first and second between slashes
    slashed = np.zeros(n, bool)
    for layout in LAYOUTS:
        mask = np.nonzero(fits(rows, layout) & (sizes <= WIDTH) & (sizes >= len(layout)))[0]
        own = rows[mask]
        day, year = number(own, places(layout, "d")), places(layout, "y")
        month = number(own, places(layout, "m"))
        if "b" in layout:
            names = own[:, places(layout, "b")]
            month = sum((names == np.frombuffer(x.encode(), np.uint8)).all(axis=1) * k for k, x in enumerate(MONTHS, 1)) if len(own) else month
        slashed[mask] = layout == SLASHED
        y[mask], a[mask], b[mask], width[mask] = number(own, year), *((day, month) if layout == SLASHED else (month, day)), len(layout)
        width[mask[(own[:, year[0]] != 50) | (own[:, year[1]] != 48)]] = 0
    rest = np.take_along_axis(np.concatenate([rows, np.zeros((n, WIDTH), np.uint8)], axis=1), width[:, None] + np.arange(WIDTH), axis=1)
    clock, good, given, offset = time_of_day(rest, sizes - width)
    good &= width > 0
    days, real = zip(civil_days(y, np.where(slashed, b, a), np.where(slashed, a, b)), civil_days(y, a, b), strict=True)
    known = given.copy()
    utc, unsure = np.zeros((2, n), np.int64), np.zeros((2, n), bool)
    for k in (0, 1):
        utc[k] = days[k] * DAY + clock - offset
    coded = pc.fill_null(zones, "").dictionary_encode()
    code = np.asarray(coded.indices)
    for c, zone in enumerate(coded.dictionary.to_pylist()):
        if zone in tables:
            own = np.nonzero((code == c) & ~given & good)[0]
            known[own] = True
            for k in (0, 1):
                utc[k, own], unsure[k, own] = to_utc(utc[k, own], tables[zone])
    good &= known & (real[0] | real[1])
    # Without slashes both orders are the same date.
    vote = np.where(good & slashed & (real[0] != real[1]), np.where(real[0], 1, 2), 0)
    utc[0], unsure[0] = np.where(real[0], utc[0], utc[1]), np.where(real[0], unsure[0], unsure[1])
    state = np.where(good, np.where(slashed & real[0] & real[1] & (a != b), OPEN, PLAIN), BAD)
    number_of = np.where(millis, number(rows, list(range(13))) * 1000, number(rows, list(range(10))) * SECOND)
    epoch = seconds | millis
    state, vote = np.where(epoch, EPOCH, state), np.where(epoch, 0, vote)
    utc[0] = np.where(epoch, number_of, utc[0])
    unsure[0] &= state != EPOCH
    return {"state": state, "vote": vote, "day": utc[0], "month": utc[1], "day_unsure": unsure[0], "month_unsure": unsure[1]}


FOUND = {"state": T.IntegerType(), "vote": T.IntegerType(), "day": T.LongType(), "month": T.LongType(), "day_unsure": T.BooleanType(), "month_unsure": T.BooleanType()}
ARROW = {"state": pa.int32(), "vote": pa.int32(), "day": pa.int64(), "month": pa.int64(), "day_unsure": pa.bool_(), "month_unsure": pa.bool_()}


def zone_tables(stamps: DataFrame) -> dict[str, tuple]:
    """Changes of the zones that occur, as far as the database knows them."""
    known = stamps.where(F.col("zone").isin(sorted(available_timezones()))).select("zone").distinct()
    return {r[0]: changes(r[0]) for r in known.collect()}  # at most the database's names


def normalised(stamps: DataFrame, folder: str | None = None) -> DataFrame:
    """All columns of a table with source, zone and raw, then utc_us, rule and ambiguous."""
    spark = stamps.sparkSession
    folder = folder or shared_dir(spark)
    raw, zone, source = (stamps.columns.index(c) for c in ("raw", "zone", "source"))
    tables = spark.sparkContext.broadcast(zone_tables(stamps))

    def run(batches):
        for batch in batches:
            found = parsed(batch.column(raw), batch.column(zone), tables.value)
            names = [*batch.schema.names, *[f"c{batch.num_columns + k}" for k in range(len(FOUND))]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[k], ARROW[k]) for k in FOUND]], names)

    typed = stamps.withColumns({c: F.col(c).cast("string") for c in ("raw", "zone")})
    # Columns go by number from here on, as their names may be any.
    own = [f"c{i}" for i in range(len(stamps.columns))]
    rows = mapped(typed.toDF(*own), run, [T.StructField(k, t) for k, t in FOUND.items()])
    rows = written(rows, f"{folder}/stamps")
    by = f"c{source}"
    votes = rows.where("vote > 0").groupBy(F.col(by).alias("voter")).agg(F.count_if(F.col("vote") == 1).alias("day"), F.count_if(F.col("vote") == 2).alias("month"))
    won = votes.where("day > 3 * month or month > 3 * day").select("voter", (F.col("day") > F.col("month")).alias("day_first"))
    won = won.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_ = rows.where(F.col("state") == OPEN).withColumn("own_salt", F.pmod(F.xxhash64("day", *own), F.lit(SALTS)).cast("int"))
    met = open_.join(won.hint("merge"), F.col(by).eqNullSafe(F.col("voter")) & (F.col("own_salt") == F.col("salt")), "left")
    first = F.coalesce(F.col("day_first"), F.lit(False))
    decided = met.select(*own, F.when(first, F.col("day")).otherwise(F.col("month")).alias("utc_us"), F.when(F.col("day_first").isNull(), "default").otherwise("votes").alias("rule"), F.lit(True).alias("ambiguous"))
    closed = rows.where(F.col("state") != OPEN).select(
        *own,
        F.when(F.col("state") != BAD, F.col("day")).alias("utc_us"),
        F.when(F.col("state") == BAD, "bad").when(F.col("state") == EPOCH, "epoch").otherwise("plain").alias("rule"),
        ((F.col("state") == PLAIN) & F.col("day_unsure")).alias("ambiguous"),
    )
    out = closed.union(decided)
    names = list(stamps.columns)
    for c in ("utc_us", "rule", "ambiguous"):
        names.append(fresh(stamps, c))
    return out.toDF(*names)


def op12_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = spark.read.parquet(f"{sf_dir}/stamps.parquet").select("stamp_id", "source", "zone", "raw")
    return normalised(stamps).select(F.col("stamp_id").cast("long").alias("stamp_id"), "utc_us", "rule", "ambiguous")


OP12_SQL = r"""
WITH stripped AS (
  SELECT stamp_id, source, z.name AS zone, coalesce(z.name, 'UTC') AS place,
    trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM stamps LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) z ON stamps.zone = z.name
), cut AS (
  SELECT row_number() OVER () AS rid, *, regexp_extract(t, '^(?:(20[0-9][0-9])-([0-9]{2})-([0-9]{2})|(20[0-9][0-9])([0-9]{2})([0-9]{2})|([0-9]{2})[.]([0-9]{2})[.](20[0-9][0-9])|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9][0-9])|([0-9]{2})/([0-9]{2})/(20[0-9][0-9]))(?:([T\x20])([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?$',
    ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'p', 'q', 'y5', 'sep', 'h', 'mi', 's', 'half', 'away']) AS g
  FROM stripped
), fields AS (
  SELECT *, g.y1 || g.y2 || g.y3 || g.y4 || g.y5 AS y,
    g.m1 || g.m2 || g.m3 || CASE WHEN g.b4 <> '' THEN lpad(CAST((position(g.b4 IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') ELSE '' END AS m,
    g.d1 || g.d2 || g.d3 || g.d4 AS d, g.p <> '' AS slashed,
    coalesce(try_cast(g.h AS INT), 0) AS hh, coalesce(try_cast(g.mi AS INT), 0) AS mm, coalesce(try_cast(g.s AS INT), 0) AS ss,
    try_cast(left(replace(g.away, ':', ''), 3) AS INT) AS away_h, coalesce(try_cast(right(g.away, 2) AS INT), 0) AS away_m
  FROM cut
), dates AS (
  SELECT *, y <> '' AND mm <= 59 AND ss <= 59 AND CASE WHEN g.half = '' THEN hh <= 23 ELSE hh BETWEEN 1 AND 12 END
      AND (g.away IN ('', 'Z') OR (abs(away_h) <= 14 AND away_m <= 59)) AS good,
    CASE WHEN slashed THEN try_cast(y || '-' || g.q || '-' || g.p AS DATE) ELSE try_cast(y || '-' || m || '-' || d AS DATE) END AS day_date,
    CASE WHEN slashed THEN try_cast(y || '-' || g.p || '-' || g.q AS DATE) END AS month_date,
    CAST((((CASE WHEN g.half = '' THEN hh ELSE hh % 12 + CASE WHEN g.half = 'PM' THEN 12 ELSE 0 END END) * 60 + mm) * 60 + ss) AS BIGINT) * 1000000 AS clock,
    CASE WHEN g.away = 'Z' THEN 0 WHEN g.away <> '' THEN CAST(60 * abs(away_h) + away_m AS BIGINT) * 60000000 * CASE WHEN g.away[1] = '-' THEN -1 ELSE 1 END END AS fixed
  FROM fields
), judged AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{10}|[0-9]{13}') THEN 'epoch' WHEN t IS NULL OR NOT good OR (fixed IS NULL AND zone IS NULL) OR coalesce(day_date, month_date) IS NULL THEN 'bad'
      WHEN slashed AND day_date IS NOT NULL AND month_date IS NOT NULL AND day_date <> month_date THEN 'open' ELSE 'plain' END AS state
  FROM dates
), votes AS (
  SELECT source AS voter, count(*) FILTER (month_date IS NULL) AS n_day, count(*) FILTER (day_date IS NULL) AS n_month
  FROM judged WHERE state = 'plain' AND slashed GROUP BY source
), chosen AS (
  SELECT j.*, CASE WHEN state <> 'open' THEN coalesce(day_date, month_date) WHEN n_day > 3 * n_month THEN day_date ELSE month_date END AS own_date,
    CASE WHEN state <> 'open' THEN state WHEN n_day > 3 * n_month OR n_month > 3 * n_day THEN 'votes' ELSE 'default' END AS rule
  FROM judged j LEFT JOIN votes v ON j.source IS NOT DISTINCT FROM v.voter
), walls AS (
  SELECT *, CASE WHEN rule NOT IN ('bad', 'epoch') THEN epoch_us(CAST(own_date AS TIMESTAMP)) + clock END AS wall FROM chosen
), around AS (
  SELECT *, epoch_us(timezone(place, timezone('UTC', make_timestamp(wall - 86400000000)))) - wall + 86400000000 AS before,
    epoch_us(timezone(place, timezone('UTC', make_timestamp(wall + 86400000000)))) - wall - 86400000000 AS behind
  FROM walls
), tried AS (
  SELECT *, epoch_us(timezone(place, timezone('UTC', make_timestamp(wall - before)))) = wall AS old_holds,
    epoch_us(timezone(place, timezone('UTC', make_timestamp(wall - behind)))) = wall AS new_holds
  FROM around
)
SELECT stamp_id,
  CASE WHEN rule = 'epoch' THEN CAST(t AS BIGINT) * CASE WHEN length(t) = 10 THEN 1000000 ELSE 1000 END
    WHEN rule = 'bad' THEN NULL WHEN fixed IS NOT NULL THEN wall - fixed
    WHEN old_holds OR NOT new_holds THEN wall - before ELSE wall - behind END AS utc_us,
  rule, rule IN ('votes', 'default') OR (rule = 'plain' AND fixed IS NULL AND before <> behind AND old_holds = new_holds) AS ambiguous
FROM tried
"""
