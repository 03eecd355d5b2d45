"""Operator 3 against plain Python and SQL."""

import hashlib
import random
import re

import duckdb

from leafmill.llm import repeats

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i is not None, i or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(spark, path):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op3_phrase_automata(spark, path).collect())


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(rows)
    assert got(spark, SMALL) == want and any(0 < r[3] < r[2] for r in want)


def test_planted_passages(spark, make):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    p, q, hot = text(75), text(49), text(120)
    rows = [(3, p + text(20)), (1, text(30) + p), (2, text(5) + p[10:70] + text(5) + p[:50]), (9, q + text(3)), (4, text(3) + q), (5, q + q + q), (6, ["z"] * 400), (7, ["z"] * 130 + text(3)), (8, ["a", "b"] * 80), (11, ["b", "a"] * 90), (12, p[:49]), (13, text(60)), (14, p[:50])]
    rows += [(100 + i, hot[i % 40 : 60 + i % 55] + text(i % 7)) for i in range(150)]
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in rows]
    assert got(spark, make(rows)) == plain(rows)


def test_odd_rows(spark, make, odd):
    same = " ".join(f"w{i}" for i in range(80))
    rows = [*odd, (30, same), (30, same), (31, same + " x"), (29, "y " + same), (None, same), (32, same), (30, "q " + same), (33, "é\U0001f600 " + same)]
    assert got(spark, make(rows)) == plain(rows)
    assert got(spark, make([])) == []


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted((True, *r) for r in con.sql(repeats.OP3_SQL).project("doc_id, n_words, n_removed, kept_sha256").fetchall())
    assert got(spark, SMALL) == want
