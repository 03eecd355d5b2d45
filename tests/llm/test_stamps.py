"""Operator 12 against a plain form: one pattern, datetime, and zoneinfo's fold."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from leafmill.llm import stamps

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
Y = "20[0-9][0-9]"
SHAPE = re.compile(
    rf"(?:(?P<y1>{Y})-(?P<m1>[0-9]{{2}})-(?P<d1>[0-9]{{2}})|(?P<y2>{Y})(?P<m2>[0-9]{{2}})(?P<d2>[0-9]{{2}})|(?P<d3>[0-9]{{2}})[.](?P<m3>[0-9]{{2}})[.](?P<y3>{Y})"
    rf"|(?P<d4>[0-9]{{2}}) (?P<b4>{'|'.join(MONTHS)}) (?P<y4>{Y})|(?P<p>[0-9]{{2}})/(?P<q>[0-9]{{2}})/(?P<y5>{Y}))"
    r"(?:[T ](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2}))?(?: ?(?P<half>[AP]M))?(?: ?(?P<away>Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
)
ZERO = datetime(1970, 1, 1)
KNOWN = stamps.available_timezones()


def date(y, m, d):
    try:
        return datetime(y, m, d)
    except ValueError:
        return None


def read(raw, zone):
    """bad, or (epoch, us), or (dates by day and month first, to_utc)."""
    t = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", t):
        return "epoch", int(t) * (10**6 if len(t) == 10 else 1000)
    m = SHAPE.fullmatch(t)
    if not m:
        return "bad", None
    g = m.groupdict()
    y = int(next(g[k] for k in ("y1", "y2", "y3", "y4", "y5") if g[k]))
    h, mi, s = (int(g[k] or 0) for k in ("h", "mi", "s"))
    if mi > 59 or s > 59 or not (1 <= h <= 12 if g["half"] else h <= 23):
        return "bad", None
    if g["half"]:
        h = h % 12 + 12 * (g["half"] == "PM")
    fixed = None
    if g["away"]:
        n = g["away"].replace(":", "")
        fixed = 0 if n == "Z" else (int(n[1:3]) * 60 + int(n[3:])) * (-1 if n[0] == "-" else 1)
        if n != "Z" and (int(n[1:3]) > 14 or int(n[3:]) > 59):
            return "bad", None
    elif zone not in KNOWN:
        return "bad", None
    if g["p"]:
        dates = [date(y, int(g["q"]), int(g["p"])), date(y, int(g["p"]), int(g["q"]))]
    else:
        month = next((int(g[k]) for k in ("m1", "m2", "m3") if g[k]), None) or MONTHS.index(g["b4"]) + 1 if not any(g[k] == "00" for k in ("m1", "m2", "m3")) else 0
        dates = [date(y, month, int(next(g[k] for k in ("d1", "d2", "d3", "d4") if g[k])))] * 2
    if dates == [None, None]:
        return "bad", None

    def utc(d):
        wall = d + timedelta(hours=h, minutes=mi, seconds=s)
        if fixed is not None:
            return (wall - ZERO) // timedelta(microseconds=1) - fixed * 60 * 10**6, False
        first, second = (wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1))
        own = first.astimezone(timezone.utc).replace(tzinfo=None)
        return (own - ZERO) // timedelta(microseconds=1), first.utcoffset() != second.utcoffset()

    return "dates", (dates, utc, bool(g["p"]))


def plain(rows):
    votes = defaultdict(Counter)
    found = [read(raw, zone) for _, _, zone, raw in rows]
    for (_, source, _, _), (kind, x) in zip(rows, found, strict=True):
        if kind == "dates" and x[2] and None in x[0]:
            votes[source][x[0][0] is None] += 1
    out = Counter()
    for (i, source, _, _), (kind, x) in zip(rows, found, strict=True):
        if kind != "dates":
            out[i, x, kind, False] += 1
            continue
        dates, utc, slashed = x
        v = votes[source]
        if slashed and None not in dates and dates[0] != dates[1]:
            day, month = v[False], v[True]
            out[i, utc(dates[0] if day > 3 * month else dates[1])[0], "votes" if day > 3 * month or month > 3 * day else "default", True] += 1
        else:
            own = utc(dates[0] or dates[1])
            out[i, own[0], "plain", own[1]] += 1
    return out


def check(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    table.write.mode("overwrite").parquet(f"{tmp_path}/stamps.parquet")
    got = Counter(tuple(r) for r in stamps.op12_stamps(spark, str(tmp_path)).select("stamp_id", "utc_us", "rule", "ambiguous").collect())
    assert got == plain(rows)


HAND = [
    "2024-02-29", "2023-02-29", "2100-01-01", "1999-12-31", "2024-1-01", "20240229", "20240230", "01.02.2024", "01.02.24", "01 Feb 2024", "01 feb 2024", "00 Feb 2024", "31 Apr 2024", "01 Mai 2024",
    "2024-01-01T00:00", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01 12:00 AM", "2024-01-01 12:00PM", "2024-01-01 13:00 PM", "2024-01-01 00:30 AM", "2024-01-01 01:02:03  PM", "2024-01-01 01:02:03 PM Z",
    "2024-01-01 01:02:03 PM+05:30", "2024-01-01T01:02:03 -1459", "2024-01-01T01:02:03+15:00", "2024-01-01T01:02:03+0560", "2024-01-01Z", "2024-01-01T01:02z", "2024-01-01T01:02Z ", "2024-01-01T01:02ZZ", "2024-01-01T01:02 +1:00", "2024-01-01T01", "2024-01-01T", "2024-01-01 01:02 A", "2024-01-01 01:02pm",
    "1706370364", "1706370364123", "17063703641", "-170637036", "0000000000", "9999999999999", "170637036٤", "٢024-01-01", "2024–01–01", "2024-01-01\x00", "\x002024-01-01", "2024-01-01\x85", " \t\n\x0b\x0c\r2024-01-01 01:02\r\n", "\xa02024-01-01", "x" * 100_000, "2024-01-01 " + " " * 100_000, "2024-01-01 01:02:03 AM +05:301",
    "13/05/2024", "05/13/2024", "13/13/2024", "05/05/2024", "05/06/2024", "29/02/2023", "30/02/2024 10:00", "02/29/2024", "00/01/2024", "05/06/2024 10:00 PM +02:00", "31/12/2024T23:59:59Z",
    "2024-03-31 02:00", "2024-03-31 02:59:59", "2024-03-31 03:00", "2024-03-31 01:59:59", "2024-10-27 02:00", "2024-10-27 02:59:59", "2024-10-27 03:00", "2024-10-27 01:59:59", "2024-11-03 01:30", "2024-03-10 02:30", "10/11/2024 02:30", "03/10/2024 02:30", None, "", "  ",
]


def test_hand_written(spark, tmp_path):
    zones = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", None, "", "Mars/Base", "europe/berlin"]
    rows = [(k, f"s{k % 5}" if k % 6 else None, zones[k % len(zones)], raw) for k, raw in enumerate(HAND * 11)]
    check(spark, tmp_path, [*rows, *rows[:40], (None, "s0", "UTC", "05/06/2024"), (None, "s0", "UTC", "05/06/2024")])


def test_drawn(spark, tmp_path):
    rnd = random.Random(5)
    two = lambda most: f"{rnd.randint(0, most):02d}"

    def one():
        y, m, d = f"20{two(99)}", two(13), two(32)
        day = rnd.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {rnd.choice(MONTHS)} {y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}"])
        clock = rnd.choice(["", rnd.choice("T ") + f"{two(24)}:{two(60)}" + rnd.choice(["", f":{two(60)}"]) + rnd.choice(["", "", "AM", " PM"]) + rnd.choice(["", "", "Z", " Z", f"+{two(15)}:{two(60)}", f" -{two(15)}{two(60)}"])])
        text = day + clock
        if rnd.random() < 0.15:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice(["", rnd.choice("0:/ TZPM.-+é")]) + text[k + 1 :]
        return text

    zones = rnd.sample(sorted(KNOWN), 30)
    rows = [(k, rnd.choice(["a", "b", "c", "d", None]), rnd.choice(zones), one()) for k in range(12000)]
    check(spark, tmp_path, rows)


def test_all_changes_of_all_zones_are_found():
    rnd, zero = random.Random(3), datetime(1970, 1, 1, tzinfo=timezone.utc)
    import numpy as np

    for zone in rnd.sample(sorted(KNOWN), 60) + ["Africa/Casablanca", "Asia/Gaza"]:
        begins, ends, offsets = stamps.changes(zone)
        place = ZoneInfo(zone)
        for t in (rnd.randint(946684800, 4102444799) for _ in range(200)):
            off = int((zero + timedelta(seconds=t)).astimezone(place).utcoffset().total_seconds())
            wall = (t + off) * 10**6
            got, unsure = stamps.to_utc(np.array([wall]), (begins, ends, offsets))
            assert unsure[0] or got[0] == t * 10**6, (zone, t)


def test_votes_need_over_three_times(spark, tmp_path):
    def source(name, day, month):
        return [(0, name, "UTC", "13/05/2024")] * day + [(0, name, "UTC", "05/13/2024")] * month + [(1, name, "UTC", "05/06/2024")]

    check(spark, tmp_path, source("a", 3, 1) + source("b", 4, 1) + source("c", 0, 0) + source("d", 0, 1) + source("e", 1, 4) + source(None, 1, 0))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    check(spark, tmp_path, [])
    odd = spark.createDataFrame([(1, "x", "c", "UTC", "05/06/2024", "v", 1.5, "k"), (2, "x", "c", None, None, "v", 2.5, "k")], "`a.b` long, rule string, source string, zone string, raw string, day string, utc_us double, text string")
    got = stamps.normalised(odd)
    assert got.columns == ["a.b", "rule", "source", "zone", "raw", "day", "utc_us", "text", "utc_us_", "rule_", "ambiguous"]
    assert sorted(got.select("utc_us", "utc_us_", "rule_", "rule", "day").collect()) == [(1.5, 1714953600000000, "default", "x", "v"), (2.5, None, "bad", "x", "v")]


@pytest.mark.parametrize("n", [3000])
def test_one_source_with_all_rows_is_spread(spark, tmp_path, n):
    rows = [(k, "hot", "UTC", f"05/{k % 9 + 1:02d}/2024 10:00") for k in range(n)] + [(n, "hot", "UTC", "13/05/2024")]
    check(spark, tmp_path, rows)
