"""Personal data: identifiers in texts, also where they are disguised.

Plain identifiers are found in the text as it is. A text that shows signs of disguise also goes through a
transducer, which writes a normalised text and, for every character of it, the source characters it came
from: homoglyphs and wide forms become ASCII, spelled digits beside other digits, spelled or not, become digits, and
``(at)``, ``[dot]``, ``name at host dot org``, ``10 dot 0`` and the like become ``@`` and ``.``. Identifiers of the normalised text are mapped
back to source characters and added unless a plain one of their kind covers them; a plain one may be a
fragment of them, and both are listed.

All searches are linear in the text's length. Null and empty texts have no spans; repeated rows are treated
alike and all stay; other columns are ignored; an empty table gives no rows. No row meets another, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import map_batches, table, text_or_empty

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# atomic runs of digits, begun at the run's first digit, match what plain ones do, without trying every start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Letters of other scripts that look like ASCII ones. Fixed values.
HOMOGLYPHS = dict(zip("аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁɡαΑβΒεΕΖηΗιΙκΚΜνΝοΟρΡτΤυΥχΧ", "aAbBeEkKmMhHoOpPcCtTyYxXiIjJsSdgaAbBeEZnHiIkKMvNoOpPtTuYxX"))
HOMOGLYPHS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-"}
#: Spelled digits. Fixed values.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_SPELLED = rf"(?:{'|'.join(DIGITS)})"
#: One spelled digit or some plain ones, and what may part them.
_TOKEN, _GAP = rf"(?:{_SPELLED}\b|[0-9]++)", r"[\s,.-]{1,3}"
# case matters: folded, the class would also match characters that HOMOGLYPHS lacks, as the micro sign
_GLYPH = f"(?-i:[{''.join(map(re.escape, HOMOGLYPHS))}])"
#: Signs of disguise; only texts that show one are normalised.
_SIGN = re.compile(rf"{_GLYPH}|[\[({{<]\s?(?:at|dot)\s?[\])}}>]|\bdot\b|\b{_SPELLED}{_GAP}{_TOKEN}|[0-9]{_GAP}{_SPELLED}\b", re.I)
_STEP = re.compile(
    rf"(?P<digits>\b(?:plus\s)?{_TOKEN}(?:{_GAP}{_TOKEN})++|\b{_SPELLED}(?=\sdot\s)|(?<=\sdot\s){_SPELLED}\b)"
    rf"|(?P<at>\s?[\[({{<]\s?at\s?[\])}}>]\s?|(?<=[A-Za-z0-9_])\sat\s(?=[A-Za-z0-9-]+\sdot\s[A-Za-z]))"
    rf"|(?P<dot>\s?[\[({{<]\s?dot\s?[\])}}>]\s?|(?<=[A-Za-z0-9])\sdot\s(?=[A-Za-z0-9]))"
    rf"|(?P<glyph>{_GLYPH})",
    re.I,
)
_DIGIT_OF = re.compile(rf"plus|{_SPELLED}|[0-9]", re.I)
_LETTER = re.compile("[a-z]", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every plain identifier, kinds by index in KINDS, in order."""
    found, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def normalise(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text, and the first and end source character of each of its characters."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def put(piece: str, first: int, end: int | None = None) -> None:
        out.append(piece)
        starts.extend(range(first, first + len(piece)) if end is None else [first] * len(piece))
        ends.extend(range(first + 1, first + len(piece) + 1) if end is None else [end] * len(piece))

    at = 0
    for m in _STEP.finditer(text):
        put(text[at : m.start()], at)
        at = m.end()
        if m["digits"]:
            if not _LETTER.search(m[0]):  # plain digits only
                put(m[0], m.start())
                continue
            for d in _DIGIT_OF.finditer(m[0]):
                put(d[0] if d[0].isdigit() else DIGITS.get(d[0].lower(), "+"), m.start() + d.start(), m.start() + d.end())
        else:
            put("@" if m["at"] else "." if m["dot"] else HOMOGLYPHS[m[0]], m.start(), m.end())
    put(text[at:], at)
    return "".join(out), starts, ends


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and the spans that only the normalised text shows; both as (start, kind, end)."""
    base = detect(text)
    more: list[tuple[int, int, int]] = []
    if _SIGN.search(text):
        plain, starts, ends = normalise(text)
        taken = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
        for s, kind, e in detect(plain):
            first, end = starts[s], ends[e - 1]
            # spans of a kind are apart, so only the last one that starts by then can cover this one
            at = bisect_right(taken[kind], first, key=lambda x: x[0])
            if not at or taken[kind][at - 1][1] < end:
                more.append((first, kind, end))
    return base, sorted(more)



def scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key and ``spans``, an array of (kind, start, end, disguised), code points, end exclusive."""

    def start():
        def run(cols):
            both = [find(t) for t in cols["t"]]
            row = lambda x, hidden: {"kind": KINDS[x[1]], "start": x[0], "end": x[2], "disguised": hidden}
            return {key: cols[key], "spans": [[row(x, h) for x, h in sorted([(x, False) for x in b] + [(x, True) for x in m])] for b, m in both]}

        return run

    return map_batches(docs.select(key, text_or_empty(text_col).alias("t")), f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint, disguised: boolean>>", start)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every identifier in ``text_col`` replaced by its kind, as ``<EMAIL>``; null stays null.

    Spans that overlap are replaced together, by the kind of the first."""

    def start():
        def hide(text: str | None) -> str | None:
            if not text:
                return text
            base, more = find(text)
            out, at = [], 0
            for s, k, e in sorted(base + more):
                if s >= at:
                    out.append(text[at:s] + f"<{KINDS[k].upper()}>")
                at = max(at, e)
            return "".join([*out, text[at:]])

        return lambda cols: cols | {text_col: [hide(t) for t in cols[text_col]]}

    return map_batches(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), start)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: ~x.disguised)
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    found = found.withColumn("base", base)
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size(F.filter("spans", lambda x: x.disguised)).cast("long").alias("n_disguised"))
