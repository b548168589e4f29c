"""Operator 1: format-preserving Feistel pseudonyms for personal data.

Numbers are found by format and validated (Luhn for cards, mod 97 for IBANs, real calendar dates,
octets, numbering-plan rules); what passes is mapped to an integer of its format's domain, permuted
there by a keyed Feistel network with cycle walking, and written back in the same format, valid
again. The permutation depends on key, kind and format only, so equal values have equal
pseudonyms in all documents, different values different ones, and the key's holder can invert them.

A format is kind, separators and widths: a day written with one digit stays one with one digit, so the same date in another
width is another value. Mail names are permuted letter by letter within their case; Me@x.org and me@x.org are
two values. A dotted quad after a word for a version is none of ours.

One whole text at a time, in one task, without a shuffle; time and memory grow with the text alone. Defined results: null and
empty texts give the empty text; repeated rows are treated alike; an empty table gives an empty one; of finds that overlap
the first counts, at one place that of the kind tried first; only doc_id and text are read, so other columns cannot clash. The
operator needs a key: treated() fails without one.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: The session setting that holds the key, and the key of query() where none is set: its tables are invented.
KEY_SETTING, TRIAL_KEY = "spark.lumenfold.pii.key", "trial key, not for production"
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
KINDS = ("email", "card", "iban", "ssn", "phone", "date", "ip")

#: One pass over the text; the alternatives are tried in this order at each place.
FOUND = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})
    | (?P<iban>\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b)
    | (?P<date>(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d-]|\.\d))
    | (?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))
    | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<phone>(?<![\w+])(?:\+1[\x20.-]?)?(?:\(\d{3}\)\x20?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?!\d)|(?<![\w+])\+[1-9]\d{0,2}(?:(?:[\x20.-]\d(?=[\x20.-]))?[\x20.-]?\d{2,4}){2,4}(?!\d))
    | (?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<sep>[\x20-])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}[\x20-]\d{6}[\x20-]\d{5})(?![\w-]))""",
    re.VERBOSE | re.ASCII,
)
#: Characters of an IBAN by country.
IBAN_SIZES = {x[:2]: int(x[2:]) for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24
    FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
    MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29
    VA22 VG24 XK20 YE30""".split()}


def permuted(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: an unbalanced Feistel network on a*b >= size, walked until inside."""
    if size < 2:
        return x
    a = int(size**0.5) + 1 if size < 2**50 else 1 << (size.bit_length() + 1) // 2
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def f(r: int, half: int) -> int:
        data = tweak + b"|" + str(size).encode() + bytes([r]) + half.to_bytes(width, "big")
        return int.from_bytes(hashlib.shake_128(key + data).digest(width), "big")

    while True:
        left, right = divmod(x, b)  # left < a, right < b
        if back:
            for r in reversed(range(ROUNDS)):
                if r % 2:
                    right = (right - f(r, left)) % b
                else:
                    left = (left - f(r, right)) % a
        else:
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + f(r, left)) % b
                else:
                    left = (left + f(r, right)) % a
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97


def refilled(form: str, chars: str) -> str:
    """form with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if x.isalnum() else x for x in form)


Permute = Callable[[int, int, bytes], int]


def by_class(text: str, permute: Permute, tweak: bytes) -> str:
    """Permutes the letters and digits, each within its class; the mixed-radix number is one domain."""
    kinds = [("0", 10) if x.isdigit() else ("a", 26) if x.islower() else ("A", 26) if x.isupper() else None for x in text]
    value, size = 0, 1
    for x, k in zip(text, kinds, strict=True):
        if k:
            value, size = value * k[1] + ord(x) - ord(k[0]), size * k[1]
    value = permute(value, size, tweak + "".join(k[0] if k else x for x, k in zip(text, kinds, strict=True)).encode())
    out = []
    for x, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            value, rest = divmod(value, k[1])
            x = chr(ord(k[0]) + rest)
        out.append(x)
    return "".join(reversed(out))


def date_of(said: str) -> tuple[datetime.date | None, str]:
    """The date and its form: a separator, or d/ for day/month, which is read only where month/day is no date."""
    sep = next(x for x in "-./" if x in said)
    n = [int(x) for x in said.split(sep)]
    for form, (y, m, d) in {"-": {"-": n}, ".": {".": n[::-1]}, "/": {"/": (n[2], n[0], n[1]), "d/": n[::-1]}}[sep].items():
        try:
            return datetime.date(y, m, d), form
        except ValueError:
            pass
    return None, sep


#: Words before a dotted quad that is a version.
VERSION = re.compile(r"(?i)(?<![a-z])(?:v|ver|version|release|rev|build)[.:=]?[\x20\t]*\Z")


def widths(said: str) -> tuple[int, int]:
    """Digits of the day and month, in the order of writing; 2 and 2 for ISO dates."""
    return (2, 2) if "-" in said else tuple(map(len, re.split(r"[./]", said)[:2]))


def dated(day: datetime.date, form: str, size: tuple[int, int]) -> str | None:
    """A date as form and widths write it; None where it does not fit."""
    if form == "-":
        return day.isoformat()
    if form == "d/" and day.day <= 12:
        return None  # would be read as month/day
    two = (day.month, day.day) if form == "/" else (day.day, day.month)
    if any(n == 1 and x > 9 for n, x in zip(size, two, strict=True)):
        return None
    return form[-1].join([*(str(x).zfill(n) for n, x in zip(size, two, strict=True)), str(day.year)])


def valid_iban(bare: str) -> bool:
    return 15 <= len(bare) <= 34 and mod97(bare) == 1


def ends(kind: str, said: str) -> list[str]:
    """What a match may stand for, in the order of trial: IBANs and international numbers may have taken in the next words."""
    if kind != "iban" and not (kind == "phone" and said[0] == "+" and said[1] != "1"):
        return [said]
    shorter = [said[: m.start()] for m in re.finditer(r"[\x20.-]", said)][::-1]
    if kind == "iban" and (size := IBAN_SIZES.get(said[:2])):
        return [x for x in shorter if len(x.replace(" ", "")) == size] + [said]
    return [said, *shorter]


def replaced(kind: str, said: str, permute: Permute) -> str | None:
    """The pseudonym, or None where said isn't valid for its kind."""
    tweak = kind.encode()
    bare = re.sub(r"[^0-9A-Za-z]", "", said)
    if kind == "email":
        local, _, host = said.partition("@")
        return f"{by_class(local, permute, tweak)}@{host}"
    if kind == "card":
        if luhn(bare[:-1]) != int(bare[-1]) or len(set(bare)) == 1:
            return None
        n = len(bare) - 2  # the first digit names the network and stays
        body = bare[0] + str(permute(int(bare[1:-1]), 10**n, tweak + bare[:1].encode())).zfill(n)
        return refilled(said, body + str(luhn(body)))
    if kind == "iban":
        if not valid_iban(bare):
            return None
        body = by_class(bare[4:], permute, tweak + bare[:2].encode())
        return refilled(said, bare[:2] + f"{98 - mod97(bare[:2] + '00' + body):02d}" + body)
    if kind == "ssn":
        a, g, s = int(bare[:3]), int(bare[3:5]), int(bare[5:])
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        x = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, tweak)
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "phone":
        if said.startswith("+") and not (bare[0] == "1" and len(bare) == 11):
            if not 8 <= len(bare) <= 15:
                return None
            return refilled(said, bare[:2] + str(permute(int(bare[2:]), 10 ** (len(bare) - 2), tweak + bare[:2].encode())).zfill(len(bare) - 2))
        lead, n = bare[:-10], bare[-10:]
        if n[0] in "01" or n[3] in "01":
            return None
        x = permute((int(n[:3]) - 200) * 800 * 10**4 + (int(n[3:6]) - 200) * 10**4 + int(n[6:]), 800 * 800 * 10**4, tweak)
        x, line = divmod(x, 10**4)
        return refilled(said, f"{lead}{x // 800 + 200}{x % 800 + 200}{line:04d}")
    if kind == "date":
        day, sep = date_of(said)
        if day is None or not 0 <= (x := day.toordinal() - FIRST_DAY) < DAYS:
            return None
        while True:  # walked on to a day that the same form and widths can write
            x = permute(x, DAYS, tweak)
            if new := dated(datetime.date.fromordinal(FIRST_DAY + x), sep, widths(said)):
                return new
    octets = [int(x) for x in said.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in said.split(".")):
        return None
    x = permute(int.from_bytes(bytes(octets), "big"), 2**32, tweak)
    return ".".join(map(str, x.to_bytes(4, "big")))


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid find replaced, and how many of each kind. back: from pseudonyms to values."""
    counts = dict.fromkeys(KINDS, 0)
    permute = lambda x, size, tweak: permuted(x, size, key, tweak, back)
    out, at = [], 0
    place = 0
    while m := FOUND.search(text, place):
        kind = next(k for k in KINDS if m[k] is not None)
        if kind == "ip" and VERSION.search(text, max(0, m.start() - 12), m.start()):
            place = m.end()
            continue
        tried = ends(kind, m[0])
        n, new = next(((i, x) for i, said in enumerate(tried) if (x := replaced(kind, said, permute)) is not None), (0, None))
        while new is not None and kind == "iban" and any(valid_iban(x.replace(" ", "")) for x in ends(kind, new + m[0][len(new) :])[:n]):
            new = replaced(kind, new, permute)  # walked on to where the same end is found again
        if new is None:
            # not valid as a whole: what lies within may be
            place = m.start() + 1
            continue
        out += [text[at : m.start()], new]
        at = place = m.start() + len(tried[n])
        counts[kind] += 1
    return "".join(out) + text[at:], counts


RESULT = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS])
ARROW = pa.struct([("text", pa.string())] + [(f"n_{k}", pa.int64()) for k in KINDS])
#: A text without any of these has nothing to find.
HINT = re.compile(r"\d[\x20().-]*\d|@")


def treated(spark: SparkSession, text: str = "text", key: str | None = None):
    """A struct of the pseudonymised text and the counts."""
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}")
    secret = key.encode()

    @F.arrow_udf(RESULT)
    def treat(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            said = x.as_py() or ""
            new, counts = pseudonymised(said, secret) if HINT.search(said) else (said, {})
            rows.append({"text": new} | {f"n_{k}": counts.get(k, 0) for k in KINDS})
        return pa.array(rows, ARROW)

    return treat(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", treated(spark, key=spark.conf.get(KEY_SETTING, None) or TRIAL_KEY).alias("_t")).select("doc_id", "_t.*")
