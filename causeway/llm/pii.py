"""Personal data, plain and disguised, with offsets into the source text.

Plain emails, IP addresses, card and phone numbers are found in the text as it stands. Then transducers
undo disguises: homoglyphs and invisible characters, at/dot disguises, spelled digits. Each transducer
rewrites stretches of the text and keeps for every character it writes the stretch of the source that
it stands for, so what the same detectors find afterwards maps back to source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from causeway.llm.common import documents, mapped, slices, text_or_empty, without_reserved

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A part starts only where a run of digits starts: within a run the same match would be one that began earlier.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
BYTES = 4 << 20


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of what stands plainly in the text; leftmost, without overlap within a kind, sorted."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters that look like Latin ones, by script; what the at and dot of an address are spelled as;
# digits in words; endings of addresses that a spelled dot without brackets must lead to.
CYRILLIC = dict(zip("авеёікмноорсстухіјѕԁһАВЕКМНОРСТУХІЈЅ", "abeeikmhoopcctyxijsdhABEKMHOPCTYXIJS"))
GREEK = dict(zip("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxABEZHIKMNOPTYX"))
MARKS = dict(zip("﹫․。｡‐‑‒–—−⁃   　", "@...-------    "))
INVISIBLE = "­​‌‍⁠﻿"
AT = "at|arroba|arobase|arobas"
DOT = "dot|punto|punkt|point"
WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "oh": "0",
}
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|eu|uk|us|de|fr|es|it|nl|ch|at|be|pt|pl|ru|cn|jp|in|br|mx|ca|au"
ENDINGS += "|mil|int|name|pro|mobi|xyz|online|site|shop|tech|cloud|me|tv|cc|ac|ad|ae|af|ag|al|am|ao|ar|as|aw|az|ba|bb|bd|bf|bg|bh|bi|bj|bm|bn|bo|bs|bt|bw|by|bz|cd|cf|cg|ci|ck|cl|cm|cr|cu|cv|cw|cy|cz|dj|dk|dm|do|dz|ec|ee|eg|er|et|fi|fj|fk|fm|fo|ga|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gt|gu|gw|gy|hk|hn|hr|ht|hu|id|ie|il|im|iq|ir|is|je|jm|jo|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|ma|mc|md|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|my|mz|na|nc|ne|nf|ng|ni|no|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pm|pn|pr|ps|pw|py|qa|re|ro|rs|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|sn|so|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tw|tz|ua|ug|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
#: Endings that are common words as well: behind "the dot" and the like they are no address.
WORDLIKE = frozenset("me am as do is la ma my no pa re so to".split())
ARTICLES = frozenset("the a this that each every any one first last".split())

LOOKALIKE = str.maketrans(CYRILLIC | GREEK | MARKS | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"})
UNSEEN = re.compile(f"[{INVISIBLE}]+")
OPEN, CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
BRACKETED_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){OPEN}(?:{AT}|@){CLOSE}(?=[A-Za-z0-9])", re.I)
BRACKETED_DOT = re.compile(rf"(?<=[A-Za-z0-9-]){OPEN}(?:{DOT}|\.){CLOSE}(?=[A-Za-z0-9])", re.I)
SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})(?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,8}}(?:\s{{0,3}}(?:\.|{DOT})\s{{0,3}})?\.?(?:{ENDINGS})\b)", re.I)
WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:\.|\s{{1,3}}(?:{DOT})\s{{1,3}})[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:@|\s{{1,3}}(?:{AT})\s{{1,3}})"
    rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.|\s{{1,3}}(?:{DOT})\s{{1,3}})[A-Za-z0-9-]{{1,63}}){{0,6}}\s{{1,3}}(?:{DOT})\s{{1,3}}(?:{ENDINGS})\b",
    re.I,
)
#: The same where the last dot stood in brackets and is now BOXED.
BOXED = "\ue000"
WORDED_BOXED = re.compile(
    rf"(?<![A-Za-z0-9._%+{BOXED}-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:[.{BOXED}]|\s{{1,3}}(?:{DOT})\s{{1,3}})[A-Za-z0-9_%+-]{{1,64}}){{0,4}}\s{{1,3}}(?:{AT})\s{{1,3}}"
    rf"[A-Za-z0-9-]{{1,63}}(?:(?:[.{BOXED}]|\s{{1,3}}(?:{DOT})\s{{1,3}})[A-Za-z0-9-]{{1,63}}){{0,6}}{BOXED}(?:{ENDINGS})\b",
    re.I,
)
WORDED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|\s{{1,3}}(?:{DOT})\s{{1,3}})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
WORD_AT, WORD_DOT = re.compile(rf"\s{{1,3}}(?:{AT})\s{{1,3}}", re.I), re.compile(rf"\s{{1,3}}(?:{DOT})\s{{1,3}}", re.I)
_W = "|".join(sorted(WORDS, key=len, reverse=True))
SPELLED_TWICE = re.compile(rf"\b(?:{_W})[\s,.-]{{1,3}}(?:(?:{DOT})[\s,.-]{{1,3}})?(?:{_W})\b", re.I)
SPELLED = re.compile(rf"(?:(?:\bplus\b|\+)[\s,.-]{{0,3}})?\b(?:{_W}|[0-9])(?:[\s,.-]{{1,3}}(?:(?:{DOT})[\s,.-]{{1,3}})?(?:{_W}|[0-9]))+\b", re.I)
SPELLED_TOKEN = re.compile(rf"plus|\+|{_W}|[0-9]|{DOT}", re.I)
#: A worded dot between worded digits may start an IP address; a number in words has this many digits at least.
LEAST_SPELLED = 7


def _odd_table() -> np.ndarray:
    table = np.zeros(0x20000, bool)
    table[[*LOOKALIKE, *map(ord, INVISIBLE)]] = True
    return table


def _small(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


ODD_TABLE = _odd_table()
#: By the first three letters (0: no letter, 27: not ASCII): whether a digit in words begins so.
HEADS = np.zeros((28, 28, 28), bool)
for _w in WORDS:
    HEADS[tuple(map(_small, f"{_w} "[:3]))] = True
SMALL = np.array([_small(chr(c).lower()) if c < 128 else 27 for c in range(129)], np.uint8)


def _looks_odd(points: np.ndarray) -> bool:
    return bool(ODD_TABLE[np.minimum(points, 0x1FFFF)].any())


def _looks_spelled(points: np.ndarray) -> bool:
    """Whether three words that begin like digits in words follow closely: what a spelled number cannot do without."""
    x = SMALL[np.minimum(points, 128)]
    if len(x) < 9:
        return False
    x = np.r_[0, x, 0].astype(np.uint8)
    at = np.flatnonzero((x[:-3] == 0) & (x[1:-2] > 0))
    at = at[HEADS[x[at + 1], x[at + 2], x[at + 3]]]
    near = np.diff(at) <= 18
    return bool((near[1:] & near[:-1]).any())


class Rewritten:
    """A text with, for each of its characters, the stretch of the source that it stands for and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def translate(self, table: dict) -> None:
        text = self.text.translate(table)
        self.changed |= np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) != np.frombuffer(self.text.encode("utf-32-le", "replace"), np.uint32)
        self.text = text

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Sorted edits without overlap: [a, b) becomes the string, every character of which stands for all of [a, b)."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.changed = (np.concatenate([*x, y[at:]]) for x, y in ((start, self.start), (end, self.end), (changed, self.changed)))


def _unspelled(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Edits that turn digits in words into digits, and where numbers of 10 to 15 digits without a plus begin and end among the edits."""
    edits, numbers = [], []
    for m in SPELLED.finditer(text):
        tokens = [(m.start() + t.start(), m.start() + t.end(), t[0].lower()) for t in SPELLED_TOKEN.finditer(m[0])]
        spelled = sum(t in WORDS for _, _, t in tokens)
        digits = sum(t in WORDS or t.isdigit() for _, _, t in tokens)
        dots = sum(t not in WORDS and t.isalpha() and t != "plus" for _, _, t in tokens)
        if digits < (4 if dots == 3 else LEAST_SPELLED) or 2 * spelled < digits:
            continue
        first = len(edits)
        for k, (a, b, t) in enumerate(tokens):
            to = tokens[k + 1][0] if k + 1 < len(tokens) else b  # what separates tokens goes with the one before
            edits.append((a, b, "+" if t in ("plus", "+") else WORDS.get(t) or (t if t.isdigit() else ".")))
            if to > b:
                edits.append((b, to, ""))
        if tokens[0][2] not in ("plus", "+") and not dots and 10 <= digits <= 15:
            numbers.append((first, len(edits)))
    return edits, numbers


def _worded(text: str) -> list[re.Match]:
    """Worded addresses without those like "at the dot is"."""
    found = []
    for m in WORDED.finditer(text):
        tail = re.split(r"[\s.@]+", m[0].lower())
        if tail[-1] not in WORDLIKE or tail[-3] not in ARTICLES:
            found.append(m)
    return found


def _boxed(now: "Rewritten") -> list[re.Match]:
    """Addresses with a worded at whose last dot stood in brackets."""
    dots = [k for k in np.flatnonzero(now.changed & (now.end - now.start > 1)) if now.text[k] == "."]
    if not dots:
        return []
    chars = list(now.text)
    for k in dots:
        chars[k] = BOXED
    return list(WORDED_BOXED.finditer("".join(chars)))


def disguised(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What shows only after the disguises are undone, as ``plain`` gives it; what overlaps a known span is left out."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = not text.isascii() and _looks_odd(points)
    spelled = _looks_spelled(points) and SPELLED_TWICE.search(text)
    low = text.lower()
    brackets = any(c in text for c in "[({<")
    first = "@" in text or brackets and (BRACKETED_AT.search(text) or BRACKETED_DOT.search(text)) or any(w in low for w in DOT.split("|")) and (WORDED.search(text) or WORDED_IP.search(text))
    if not (odd or first or spelled):
        return []
    now = Rewritten(text)
    if odd:
        now.translate(LOOKALIKE)
        now.replace([(m.start(), m.end(), "") for m in UNSEEN.finditer(now.text)])
    if odd or first:
        now.replace([(m.start(), m.end(), "@") for m in BRACKETED_AT.finditer(now.text)])
        now.replace([(m.start(), m.end(), ".") for m in BRACKETED_DOT.finditer(now.text)])
        now.replace([(m.start(), m.end(), "@") for m in SPACED_AT.finditer(now.text)])
        now.replace([(x.start(), x.end(), ".") for m in WORDED_IP.finditer(now.text) for x in WORD_DOT.finditer(now.text, *m.span())])
        edits = []
        worded = _worded(now.text)
        worded += [m for m in _boxed(now) if all(m.end() <= w.start() or m.start() >= w.end() for w in worded)]
        for m in sorted(worded, key=lambda m: m.start()):
            own = [(x.start(), x.end(), "@") for x in WORD_AT.finditer(now.text, *m.span())][-1:]
            own = [] if "@" in m[0] else own
            edits += sorted(own + [(x.start(), x.end(), ".") for x in WORD_DOT.finditer(now.text, *m.span())])
        now.replace(edits)
    first_found, second_found = _shown(now, text), []
    if odd or spelled:
        edits, numbers = _unspelled(now.text)
        for a, b in numbers:
            digits = "".join(new for _, _, new in edits[a:b])
            if not (12 <= len(digits) and luhn(digits)):
                second_found.append((int(now.start[edits[a][0]]), 3, int(now.end[edits[b - 1][1] - 1])))
        now.replace(edits)
        second_found += _shown(now, text)
    # What shows before numbers are put together comes first: a number in words beside it must not swallow it.
    kept: list[tuple[int, int, int]] = []
    for a, k, b in [*sorted(set(first_found)), *sorted(set(second_found))]:
        if all(b <= x or a >= y for x, _, y in known) and all(b <= x or a >= y for x, _, y in kept):
            kept.append((a, k, b))
    return sorted(kept)


def _shown(now: Rewritten, text: str) -> list[tuple[int, int, int]]:
    """What the detectors find in the rewritten text that the source does not show: with a changed character, or with some gone between."""
    if not now.changed.any() and len(now.text) == len(text):
        return []
    gap = np.r_[False, now.start[1:] != now.end[:-1]]
    return [(int(now.start[a]), k, int(now.end[b - 1])) for a, k, b in plain(now.text) if now.changed[a:b].any() or gap[a + 1 : b].any()]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])
SPAN_DDL = "array<struct<kind: string, start: bigint, end: bigint, added: boolean>>"


def find_pii(docs: DataFrame, text: str = "text", digests: bool = False) -> DataFrame:
    """The rows of ``docs`` with pii, an array of (kind, start, end, added) sorted by start and then kind.

    Offsets count code points, ends are exclusive; ``added`` marks what was found under a disguise. With
    ``digests`` also n_email, n_ip, n_card, n_phone (plain ones), base_sha256 and spans. A null text counts
    as empty and has none. Each row is looked at by itself and whole, so repeated rows agree. Columns that
    clash with the results are replaced, those that begin with an underscore dropped.
    """
    extra = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"] if digests else []
    docs = without_reserved(docs).drop("pii", *extra).withColumn("_text", text_or_empty(text))
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields if f.name != "_text"]
    names = [n for n, _ in fields] + ["pii", *extra]
    ddl = ", ".join(f"`{n}` {t}" for n, t in [*fields, ("pii", SPAN_DDL)] + [(n, "bigint" if n[:2] == "n_" else "string") for n in extra])

    def find(batches):
        for part in slices(batches, "_text", BYTES):
            spans, digest = [], [[] for _ in extra]
            for t in part.column("_text").to_pylist():
                base = plain(t)
                new = disguised(t, base)
                every = sorted([(*x, False) for x in base] + [(*x, True) for x in new])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "added": d} for a, k, b, d in every])
                if extra:
                    said = lambda xs: ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in xs)
                    for k in range(4):
                        digest[k].append(sum(x[1] == k for x in base))
                    digest[4].append(hashlib.sha256(said(base).encode()).hexdigest())
                    digest[5].append(said(every))
            columns = [c for n, c in zip(part.schema.names, part.columns) if n != "_text"]
            columns += [pa.array(spans, pa.list_(SPAN)), *(pa.array(x, pa.int64() if n[:2] == "n_" else pa.string()) for n, x in zip(extra, digest))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.transform(mapped, find, ddl)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir).select("doc_id", "text"), digests=True).drop("pii", "text")
