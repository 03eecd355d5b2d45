"""Personal data: exact base patterns, and boosted trees over high-recall candidates.

DataFrame and SQL functions only: matches come from regular expressions, their places
from the lengths between them, the trees are SQL conditions.

The four base kinds stay whatever the trees say. Wider generators propose further spans,
which may overlap: an e-mail address spelled out, a national phone number, a social
security number, an account number, a secret key. The trees score a candidate by its form
and by CONTEXT characters on both sides. They are fitted on SAMPLE texts written for it
(none of the corpus; plain sentences among them), on which the same generators and features run, so what the trees see
there is what they see later; on texts kept apart, the threshold of each kind is the lowest
score from which PRECISION holds, even odds at least. A candidate is kept if it reaches its kind's threshold,
overlaps no base span, and overlaps no kept one of a higher score (then: earlier, then the
kind listed first).

Null text is the empty text, with no spans. Whole texts are read, at a cost that grows
with the text and a little more than with the number of its spans. Repeated rows give
repeated results. Other columns pass by unread.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound

from .common import documents, small_table

#: The base patterns, in the order of the kinds. Possessive repeats and
#: look-behinds only spare the matcher retries from inside a run, and find the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this can't hold the kind.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
EXTRA = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|\{at\}|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/-]{20,}+=*+(?![A-Za-z0-9_])",
}
#: Texts without this can't hold the wider kind: the e-mail pattern from its "at" on, and digits of the others.
AT = r"(?:\[at\]|\(at\)|\{at\}|\sat\s)"
EXTRA_HINT = {"email": "(?i)" + EXTRA["email"][EXTRA["email"].index(AT) :].removesuffix("++)++") + ")", "secret": "[A-Za-z0-9_+/-]{20}"}
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
CONTEXT, SAMPLE, PRECISION, JUDGES = 28, 6000, 0.98, 8
#: Words that go before or after such data, and words that go with other numbers.
CLUES = "(?<![a-z])(?:tel|phone|fon|fax|mobil|cell|call|dial|ssn|social|security|tax|iban|account|konto|cuenta|compte|transfer|bank|mail|contact|kontakt|write|reach|token|secret|passw|api|auth|bearer|credential|key)"
OTHERS = "(?<![a-z])(?:order|invoice|ticket|serial|isbn|part|model|sku|item|version|build|batch|lot|ref|page|commit|hash|sha|md5|checksum|uuid|digest|url|path|file|meet|arriv|sold|price|score|figure|table)"
#: Words that go before "at" and a place in plain prose; places' endings; openings of keys; plain sentences.
BEFORE_AT = "look looks looked looking meet met meets hosted host hosts arrive arrived available work works worked working based stay posted post published live lives living listed found sold bought shop order ordered register registered visit read more seen see is are was be been were held stored served running sign signed join joined start started laugh point pointed stop stopped aim wait waiting check buy download downloads us me them him her it you team office page info site store home news open online here there mirrored pictured documented explained described given shown back down up over out again in on"
ENDINGS = ["com", "org", "net", "de", "fr", "edu", "io", "co.uk", "info"]
OPENINGS = ["", "", "", "", "sk-", "sk_live_", "ghp_", "xoxb-", "AKIA", "pk_", "AIza", "eyJ"]
PROSE = [
    "We look at example.com for ideas and then write our own.", "The code is hosted at github.com and mirrored at gitlab.com.", "Let us meet at walmart.com headquarters.", "Read more at nytimes.com or at the library.",
    "The train arrived at 10.45 and left at 11.02.", "They sold it at 3.99 each, then at 4.50.", "He stopped at once. Then he laughed.", "Version 1.2.3 came out in 2019, version 2.0.0 in 2021.", "The book has ISBN 978-3-16-148410-0 on its back.",
    "Order 555-123-4567 was shipped on 2024-05-06.", "Call numbers 020 7946 0018 of the shelf are for history.", "See section 4.2.1 and table 12-34-5678 of the report.", "Part 123-45-6789 of the engine is out of stock.", "The score was 210 to 123 and 4567 people came.",
    "Files are in /usr/share/doc/python3.11/examples/readme and below.", "The branch feature/user-login-page-2024-rework was merged.", "See https://example.com/articles/2023/how-to-grow-tomatoes-at-home for it.", "The class HttpConnectionPoolManagerFactory2 is never used.",
    "Commit 3f2a9c1d4b5e6f708192a3b4c5d6e7f801234567 broke the build.", "Its md5 is d41d8cd98f00b204e9800998ecf8427e, of an empty file.", "The id 550e8400-e29b-41d4-a716-446655440000 is a uuid.", "Save it as final_report_version_12_of_march.pdf please.",
    "In 2020-2021-2022-2023-2024 sales rose each year.", "Well-known-and-much-loved-in-the-1990s, the show came back.", "The key to success is practice at home. Nothing else.", "Her account of the war fills 300 pages at most.", "The secret of the old house was found in 1998.",
    "A token of thanks, number 1234-5678-9012, was handed over.", "Flight LH 1234 5678 leaves from gate B22 at noon.", "The password must be at least 12 characters long.", "Model DE12 3456 7890 1234 is the newest of the line.",
]
#: Entries that a fold copies at most in one step, characters of a text's parts, and spans that are looked through at once.
BLOCK, PART, MANY = 256, 1024, 64


def _scan(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each value the sum (by `add`) of those before it; block by block, as a fold copies its result at every step."""
    kind = "array<int>"

    def plain(own: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(own, begin, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def blocks(all_values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_values, b * BLOCK + 1, BLOCK))
        return bound(cut, lambda parts: F.flatten(F.zip_with(parts, plain(F.transform(parts, lambda x: F.aggregate(x, zero, add)), zero), plain)))

    return bound(values, lambda v: F.when(F.size(v) <= BLOCK, plain(v, zero)).otherwise(blocks(v)))


def _any_meets(spans: Column, use: Callable[[Callable], Column]) -> Column:
    """use(test), where test(span, also) tells whether one of `spans`, sorted by start, overlaps the span and passes `also`."""

    def hit(own: Column, s: Column, also: Callable[[Column], Column]) -> Column:
        return F.exists(own, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]) & also(x))

    def block(b: Column) -> Column:
        own = F.slice(spans, b * MANY + 1, MANY)
        return F.struct(F.get(own, 0)["start"].alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"), own.alias("own"))

    cut = F.when(F.size(spans) > MANY, F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / MANY).cast("int")), block))
    return bound(cut, lambda blocks: use(lambda s, also: F.when(blocks.isNull(), hit(spans, s, also)).otherwise(F.exists(blocks, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & hit(b["own"], s, also)))))


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, found) of all matches, leftmost and non-overlapping; start in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(all_found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(all_found)), lambda g: F.length(g))
        begins = bound(gaps, lambda gs: F.zip_with(_scan(F.zip_with(gs, all_found, lambda g, m: g + F.length(m)), F.lit(0), lambda a, x: a + x), gs, lambda a, g: a + g))
        return F.zip_with(begins, all_found, lambda s, m: F.struct(s.alias("start"), m.alias("found")))

    return bound(found, placed)


def _parts(text: Column) -> Column:
    """The text in parts of PART characters, so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def _between(parts: Column, a: Column, b: Column) -> Column:
    """Characters from a to b (exclusive) of the text in parts."""
    i, j = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    near = F.substring(part(i), a % PART + 1, b - a)
    far = F.concat(F.substring(part(i), a % PART + 1, F.lit(PART)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(part(j), F.lit(1), b % PART))
    return F.when(i == j, near).otherwise(far)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(found)).between(12, 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _spans(kind: str, places: Column) -> Column:
    return F.transform(
        places,
        lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["found"])).alias("end"), p["found"].alias("found")),
    )


NONE = "array<struct<start:int,rank:int,kind:string,end:int,found:string>>"


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(_spans(kind, _places(text, BASE[kind])), lambda s: _holds(kind, s["found"]))
    hint = text.contains(HINT[kind]) if HINT[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(hint, spans).otherwise(F.array().cast(NONE))


def candidate_spans(text: Column, kind: str) -> Column:
    hint = text.rlike(EXTRA_HINT.get(kind, "[0-9]{2}"))
    return F.when(hint, _spans(kind, _places(text, EXTRA[kind]))).otherwise(F.array().cast(NONE))


def _remainder_97(found: Column) -> Column:
    """The remainder that account numbers are checked by: 1 for sound ones."""
    bare = F.regexp_replace(found, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def features(parts: Column, span: Column) -> dict[str, Column]:
    """The form of a candidate, and the CONTEXT characters on either side of it."""
    found, digits = span["found"], _digits(span["found"])
    before = F.lower(_between(parts, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"]))
    after = F.lower(_between(parts, span["end"], span["end"] + CONTEXT))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "kind": span["rank"],
        "n_chars": F.length(found),
        "n_digits": F.length(digits),
        "n_kinds_of_digit": F.length(F.regexp_replace(F.array_join(F.sort_array(F.split(digits, "")), ""), r"(.)\1*", "x")),
        "n_marks": F.length(F.regexp_replace(found, "[A-Za-z0-9]", "")),
        "n_upper": F.length(F.regexp_replace(found, "[^A-Z]", "")),
        "clue": flag(before.rlike(CLUES)),
        "other": flag(before.rlike(OTHERS)),
        "clue_after": flag(after.rlike(CLUES)),
        "other_after": flag(after.rlike(OTHERS)),
        "bad_start": flag(digits.rlike("^(?:000|666|9|[01])")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "in_path": flag(before.rlike(r"[/#$_&?]$") | after.rlike(r"^[/#$_&?]")),
        "bracketed": flag(found.rlike(r"[\[({]")),
        "spelled_dot": flag(found.rlike(r"(?i)\bdot\b")),
        "loose_dot": flag(found.rlike(r"\.\s")),
        "number_before": flag(before.rlike(r"[0-9]\s*[-+*/,.]?\s*$")),
        "remainder": F.when(span["kind"] == "iban", _remainder_97(found)).otherwise(F.lit(0)),
        "hex": flag(found.rlike("^[0-9a-f]+$")),
        "plain_user": flag(found.rlike(r"(?i)^[a-z]+\s+at\s")),
        "prose_word": flag(found.rlike(rf"(?i)^(?:{BEFORE_AT.replace(' ', '|')})\s+at\s")),
        "n_turns": F.regexp_count(found, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")),
        "n_parts": F.regexp_count(found, F.lit("[/_-]")),
    }


FEATURES = [
    "kind", "n_chars", "n_digits", "n_kinds_of_digit", "n_marks", "n_upper", "clue", "other", "clue_after", "other_after", "bad_start", "assigned", "in_path", "bracketed", "spelled_dot", "loose_dot", "number_before", "remainder", "hex", "plain_user", "prose_word", "n_turns", "n_parts",
]


def _account(rnd: random.Random, sound: bool) -> str:
    country = rnd.choice(["DE", "FR", "ES", "GB", "IT", "NL"])
    body = "".join(rnd.choice("0123456789") for _ in range(rnd.choice([14, 18, 18, 20])))
    check = 98 - int(body + "".join(str(ord(c) - 55) for c in country) + "00") % 97
    whole = f"{country}{check if sound else (check + rnd.randint(1, 90)) % 97:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rnd.random() < 0.6 else whole


def _drawn(rnd: random.Random, kind: str, real: bool) -> tuple[list[str], str, list[str]]:
    """Words that may go before, the text itself and words that may go after, of one piece of personal data or of a look-alike."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(3, 9)))
    area = f"{rnd.randint(2, 9)}{digits(2)}"
    if kind == "email":
        place = f"{name()}{rnd.choice(['', '', '-' + name(), '.' + name()])}.{rnd.choice(ENDINGS)}"
        if real:
            at, dot = rnd.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), ("{at}", "."), (" at ", " dot "), (" (at) ", "."), ("[at]", "."), (" AT ", " DOT ")])
            if rnd.random() < 0.3:
                at, dot = " at ", "."
            user = rnd.choice([f"{name()}.{name()}", f"{name()}_{name()}", f"{name()}{digits(2)}", name(), name()])
            return ["mail:", "write to", "contact", "reach me:", "kontakt", "email", "e-mail me:", "mail to", "send mail to"], f"{user}{at}{place.replace('.', dot)}", ["please", "for details", ""]
        if rnd.random() < 0.6:
            # The places of plain prose; after a word that tells of mail only with a word of plain prose.
            word, told = (name(), False) if rnd.random() < 0.4 else (rnd.choice(BEFORE_AT.split()), rnd.random() < 0.3)
            return ["contact", "write to", "mail", "reach"] if told else ["we", "they", "you can", "then", "it was", "and", "all", "this", "files"], f"{word} at {place}", ["today", "and so on", "", "for more"]
        end = rnd.choice([f"{name()}. {name().title()}", f"{rnd.randint(1, 12)}.{digits(2)}", f"{name()}.The"])
        return ["we meet", "arrived", "sold", "prices", "look"], f"{name()} at {end}", ["and so on", "hours", "each"]
    if kind == "phone":
        if real:
            own = rnd.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "({0}) {1} {2}"]).format(area, f"{rnd.randint(2, 9)}{digits(2)}", digits(4))
            return ["tel", "phone:", "call", "fax", "cell", "dial"], own, ["after noon", "ext", ""]
        own = rnd.choice(["{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}"]).format(rnd.choice([digits(3), "000", "1" + digits(2)]), digits(3), digits(4))
        return ["order", "invoice no.", "serial", "isbn", "version", "build", "batch"], own, ["in stock", "of the batch", "items"]
    if kind == "ssn":
        if real:
            return ["ssn", "social security number", "tax id:", "my ssn is"], f"{rnd.choice([rnd.randint(2, 6), 7, 8])}{digits(2)}".replace("666", "667") + f"-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}", ["on file", ""]
        return ["part", "model", "sku", "item", "ref"], f"{rnd.choice(['000', '666', '9' + digits(2), digits(3)])}-{digits(2)}-{digits(4)}", ["in stock", "of the batch", ""]
    if kind == "iban":
        return (["iban", "account", "konto", "transfer to", "bank:"], _account(rnd, True), ["today", ""]) if real else (["serial", "ref", "key id", "batch", "order"], _account(rnd, False), ["in stock", ""])
    alphabet = rnd.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
    opening, n = rnd.choice(OPENINGS) if real else "", rnd.choice([rnd.randint(20, 40), rnd.randint(20, 100)])
    own = opening + "".join(rnd.choice(alphabet) for _ in range(max(n - len(opening) - 1, 4))) + rnd.choice("0123456789")
    own = own.strip("-/+") + "0" * max(20 - len(own.strip("-/+")), 0)
    if real:
        before = rnd.choice(["token", "api_key", "secret", "password", "auth_token", "access key", "API key", "client_secret", "secret key", "aws_secret_access_key", "credential", "passwd"]) + rnd.choice([' = "', ": ", "=", " = '", " is ", ' : "'])
        return [rnd.choice([before, before, before, "authorization: Bearer ", "bearer "])], own, ["", ""]
    own = rnd.choice([own, own, "-".join(name() for _ in range(rnd.randint(3, 6))) + f"-{rnd.randint(2000, 2030)}", "/".join(name() for _ in range(rnd.randint(3, 6))) + str(rnd.randint(1, 99)), "".join(name().title() for _ in range(rnd.randint(3, 5))) + digits(1), "_".join(name() for _ in range(4)) + f"_{rnd.randint(1, 99)}"])
    own += "x" * max(20 - len(own), 0)
    return ["commit", "sha", "md5 checksum", "file", "url", "path", "digest of", "hash", "sha256:", "uuid", "build", "see", "version", "checksum"], own, ["in the log", "", "was merged"]


def written_texts(seed: int, n: int = SAMPLE) -> list[tuple[str, str, int, int]]:
    """(text, kind, start, end) of n texts, each with one piece of personal data in it, or (start -1) a look-alike of some kind."""
    rnd, out = random.Random(seed), []
    filler = "the of a we and it was with from they had more time under over day house long river then made every small white".split()
    for _ in range(n):
        if rnd.random() < 0.1:
            out.append((" ".join(rnd.sample(PROSE, rnd.randint(1, 3))), "none", -1, -1))
            continue
        kind, real = rnd.choice(list(EXTRA)), rnd.random() < 0.5
        before, own, after = _drawn(rnd, kind, real)
        lead = " ".join(rnd.choices(filler, k=rnd.randint(2, 9)))
        # What only its surroundings tell from plain prose keeps them.
        told = rnd.random() < 0.85 or kind == "secret" or (kind == "email" and " at " in own and "." in own)
        head = f"{lead} {rnd.choice(before)}" if told else lead
        head += "" if head[-1] in "=\"' " else " "
        tail = f" {rnd.choice(after)} {' '.join(rnd.choices(filler, k=rnd.randint(1, 6)))}"
        if head[-1] in "\"'":
            tail = head[-1] + tail
        out.append((head + own + tail, kind, len(head) if real else -1, len(head) + len(own) if real else -1))
    return out


def judged(spark: SparkSession, texts: list[tuple[str, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that the generators find in written texts."""
    rows = small_table(spark, [{"text": t, "kind": k, "start": a, "end": b} for t, k, a, b in texts], "text: string, kind: string, start: int, end: int").repartition(JUDGES)
    found = rows.withColumn("spans", F.concat(*[candidate_spans(F.col("text"), k) for k in EXTRA])).withColumn("parts", _parts(F.col("text")))
    found = found.select("kind", "start", "end", "parts", F.explode("spans").alias("span"))
    label = ((F.col("span.kind") == F.col("kind")) & (F.col("span.start") == F.col("start")) & (F.col("span.end") == F.col("end"))).cast("int")
    own = features(F.col("parts"), F.col("span"))
    got = found.select(*[own[f].alias(f) for f in FEATURES], label.alias("label")).orderBy(*FEATURES, "label").collect()  # of SAMPLE texts
    table = np.array([tuple(r) for r in got], float).reshape(len(got), len(FEATURES) + 1)
    return table[:, :-1], table[:, -1]


def _tree(rows, residual, hessian, index, depth):
    """One regression tree as nested tuples (feature, cut, below, above), leaves Newton steps."""
    g, h = residual[index].sum(), hessian[index].sum()
    leaf = float(g / (h + 1.0))
    if depth == 0 or len(index) < 40:
        return leaf
    best = (1e-3, None)
    for f in range(rows.shape[1]):
        x = rows[index, f]
        for cut in np.unique(x)[1:]:
            left = x < cut
            gl, hl = residual[index][left].sum(), hessian[index][left].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, (f, float(cut), left))
    if best[1] is None:
        return leaf
    f, cut, left = best[1]
    return (f, cut, _tree(rows, residual, hessian, index[left], depth - 1), _tree(rows, residual, hessian, index[~left], depth - 1))


def _apply(tree, rows):
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    return np.where(rows[:, tree[0]] < tree[1], _apply(tree[2], rows), _apply(tree[3], rows))


@functools.cache
def fitted(trees: int = 32, depth: int = 4, rate: float = 0.3) -> tuple[list, dict[int, float]]:
    """Boosted trees from one set of written texts; from another, for each kind the lowest score, 0 at least, from which PRECISION holds."""
    spark = SparkSession.active()
    x, y = judged(spark, written_texts(7))
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), np.arange(len(x)), depth)
        score += rate * _apply(tree, x)
        out.append((rate, tree))
    held_x, held_y = judged(spark, written_texts(8))
    held = sum(r * _apply(t, held_x) for r, t in out)
    least = {}
    for kind in EXTRA:
        mine = held_x[:, 0] == KINDS.index(kind)
        scores, own = held[mine], held_y[mine]
        cuts = np.unique(scores)[::-1]
        good = [c for c in cuts if own[scores >= c].mean() >= PRECISION]
        least[KINDS.index(kind)] = max(float(min(good)), 0.0) if good else float("inf")
    return out, least


def _sql(tree, cols: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(cols[tree[0]] < tree[1], _sql(tree[2], cols)).otherwise(_sql(tree[3], cols))


def kept_by_trees(text: Column, candidates: Column, base: Column) -> Column:
    """Of the candidates, sorted by start, those that reach the threshold, are clear of base spans and yield to no better one."""
    trees, least = fitted()

    def surplus(vector: Column) -> Column:
        """By how much the score is over the kind's threshold."""
        cols = [vector[name] for name in FEATURES]
        total = F.lit(0.0)
        for rate, tree in trees:
            total = total + F.lit(rate) * _sql(tree, cols)
        for rank, x in least.items():
            total = total - F.when(vector["kind"] == rank, F.lit(x)).otherwise(F.lit(0.0))
        return total

    def scored(parts: Column) -> Column:
        def one(s: Column) -> Column:
            f = features(parts, s)
            own = bound(F.struct(*[f[n].alias(n) for n in FEATURES]), surplus)
            return F.struct(*[s[k].alias(k) for k in ("start", "rank", "kind", "end", "found")], own.alias("score"))

        return F.filter(F.transform(candidates, one), lambda s: s["score"] >= 0)

    def clear(good: Column) -> Column:
        return _any_meets(base, lambda meets: F.filter(good, lambda s: ~meets(s, lambda b: F.lit(True))))

    def best(good: Column) -> Column:
        def better(s: Column, x: Column) -> Column:
            return (x["score"] > s["score"]) | ((x["score"] == s["score"]) & (F.struct(x["start"], x["rank"]) < F.struct(s["start"], s["rank"])))

        return _any_meets(good, lambda meets: F.filter(good, lambda s: ~meets(s, lambda x: better(s, x))))

    kept = bound(_parts(text), lambda parts: bound(scored(parts), lambda good: bound(clear(good), best)))
    plain = F.transform(kept, lambda s: F.struct(*[s[k].alias(k) for k in ("start", "rank", "kind", "end", "found")]))
    return F.when(F.size(candidates) > 0, plain).otherwise(F.array().cast(NONE))


def with_spans(docs: DataFrame, name: str = "pii", text_column: str = "text") -> DataFrame:
    """All columns, and struct `name`: an array of spans for each base kind, `base` and `all` sorted by start and kind."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.withColumn(name, F.struct(*[base_spans(text, k).alias(k) for k in BASE], *[candidate_spans(text, k).alias(f"x_{k}") for k in EXTRA]))
    base = F.sort_array(F.concat(*[F.col(f"{name}.{k}") for k in BASE]))
    found = found.withColumn(name, F.struct(*[F.col(f"{name}.{k}").alias(k) for k in BASE], base.alias("base"), F.sort_array(F.concat(*[F.col(f"{name}.x_{k}") for k in EXTRA])).alias("wide")))
    extra = kept_by_trees(text, F.col(f"{name}.wide"), F.col(f"{name}.base"))
    every = F.when(F.size(F.col(f"{name}.wide")) > 0, F.sort_array(F.concat(F.col(f"{name}.base"), extra))).otherwise(F.col(f"{name}.base"))
    return found.withColumn(name, F.struct(*[F.col(f"{name}.{k}").alias(k) for k in BASE], F.col(f"{name}.base").alias("base"), every.alias("all")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one's start and the last one's end count."""

    def done(parts: Column) -> Column:
        def pieces(reach: Column) -> Column:
            """reach: how far the spans before each one go."""
            return F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(_between(parts, F.get(reach, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))

        ends = F.transform(spans, lambda s: s["end"])
        return F.concat(F.array_join(bound(_scan(ends, F.lit(0), lambda a, x: F.greatest(a, x)), pieces), ""), _between(parts, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, bound(_parts(text), done)).otherwise(text)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(documents(spark, sf_dir).select("doc_id", "text"), "pii")
    return rows.select(
        "doc_id",
        *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("pii.base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii.all")).alias("spans"),
    )
