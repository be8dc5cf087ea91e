"""Personal data in plain and disguised form, with offsets into the source text.

Plain identifiers are found as they stand. For texts that show signs of disguise, transducers rewrite the text: homoglyphs and
zero-width characters, at/dot disguises, spelled digits. Each transducer keeps, for its output, which source characters every
output character came from; transducers compose by composing these maps. The same detectors run on the rewritten text, and
spans that a rewrite touched are mapped back to code points of the source and added. Plain spans always stay.

Row by row without a shuffle; an Arrow prefilter over whole batches leaves out texts that hold neither a digit nor an at sign nor a
sign of disguise. All patterns are linear: runs are possessive and entered at their beginning only.

Nulls and edges: null text is empty and has no spans; ids and extra columns ride along; equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.shared import append, documents

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, at sign and domain; from the at signs, so that long words cost one walk."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def detect(text: str) -> dict[str, list[Span]]:
    return {"email": list(emails(text)), "ip": list(ips(text)), "card": list(cards(text)), "phone": list(phones(text))}


# --- transducers -------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like ASCII, besides what compatibility decomposition gives.
LOOKALIKES = dict(zip("аеорсухіѕјԁһӏԛԝвкмнтАВЕКМНОРСТУХІЈЅαοιρνκτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdhlqwbkmhtABEKMHOPCTYXIJSaoipvktuxABEZHIKMNOPTYX", strict=True))
MARKS = {"․": ".", "。": ".", "｡": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@", "⊕": "+", " ": " ", " ": " ", " ": " "}
HIDDEN = "­​‌‍⁠﻿᠎"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
DIGITS = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | {"oh": "0", "nought": "0"}
#: Top-level domains that make unbracketed words an address.
DOMAINS = frozenset("com org net edu gov mil int info biz io ai co me app dev eu us uk de fr es it nl be ch at ca au in jp cn br mx pl se no dk fi ru pt gr ie example test".split())
AT_WORDS, DOT_WORDS = r"(?:at|arroba|ät)", r"(?:dot|punto|punkt|point)"
OPEN, CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_DIGIT = "(?:" + "|".join(DIGITS) + ")"


@lru_cache(maxsize=1)
def homoglyphs() -> dict[str, str]:
    """Single characters to the ASCII character that they imitate: look-alikes and compatibility forms."""
    out = dict(LOOKALIKES) | MARKS | dict.fromkeys(HIDDEN, "")
    for block in ((0x2460, 0x24FF), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2070, 0x2090)):
        for c in map(chr, range(*block)):
            plain = unicodedata.normalize("NFKD", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                out[c] = plain
    return out


class Rewritten(NamedTuple):
    """A rewritten text: pieces by their start in it, each copied from source[start:end] or standing for the whole of it."""

    text: str
    at: list[int]
    source: list[Span]
    copied: list[bool]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of text[start:end], and whether a rewrite lies in it."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[first][0] + (start - self.at[first]) * self.copied[first]
        b = self.source[last][0] + (end - self.at[last]) if self.copied[last] else self.source[last][1]
        # a piece that is not a copy, or source characters without output between copies
        return a, b, not all(self.copied[first : last + 1]) or b - a != end - start


def rewrite(text: str, pattern: re.Pattern, replace) -> Rewritten:  # noqa: ANN001
    """One transducer: each match becomes replace(match); None leaves it."""
    parts, at, source, copied, n, done = [], [], [], [], 0, 0

    def put(piece: str, span: Span, copy: bool) -> None:
        nonlocal n
        if piece:
            parts.append(piece)
            at.append(n)
            source.append(span)
            copied.append(copy)
            n += len(piece)

    for m in pattern.finditer(text):
        new = replace(m)
        if new is not None:
            put(text[done : m.start()], (done, m.start()), True)
            put(new, m.span(), False)
            done = m.end()
    put(text[done:], (done, len(text)), True)
    return Rewritten("".join(parts), at, source, copied)



GLYPHS = re.compile("[" + re.escape("".join(homoglyphs())) + "]")
BRACKETED = re.compile(rf"\s{{0,3}}(?:{OPEN}(?P<at>{AT_WORDS}|@){CLOSE}|{OPEN}(?P<dot>{DOT_WORDS}|\.){CLOSE})\s{{0,3}}", re.I)
#: Unbracketed: only as a whole address, name at host dot domain.
SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{{1,64}}(?:\s{{1,3}}{DOT_WORDS}\s{{1,3}}[A-Za-z0-9._%+-]{{1,64}}){{0,3}})(?:\s{{1,3}}{AT_WORDS}\s{{1,3}}|@)"
                    rf"(?P<host>[A-Za-z0-9-]{{1,63}}(?:(?:\s{{1,3}}{DOT_WORDS}\s{{1,3}}|\.)[A-Za-z0-9-]{{1,63}}){{1,5}})(?![A-Za-z0-9-])", re.I)  # fmt: skip
NUMBER = re.compile(rf"(?<![A-Za-z0-9])(?:(?P<plus>plus)[\s-]{{1,3}})?(?:{_DIGIT}|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:dot|point)[\s-]{{1,3}})?(?:{_DIGIT}|[0-9]+))+(?![A-Za-z0-9])", re.I)
_WORDS = re.compile(rf"{_DIGIT}|dot|point|plus|[0-9]+", re.I)


def signs(space: str) -> str:
    """What a text has that any transducer but the homoglyphs' changes: no narrower than they are. `space` is inside a class."""
    gap, far = f"[{space}]", f"[{space},.-]{{1,3}}"
    point = f"(?:(?:dot|point)[{space}-]{{1,3}})?"
    return "|".join((
        rf"[\[({{<]{gap}?(?:{AT_WORDS}|{DOT_WORDS}|[@.]){gap}?[\])}}>]",
        # an address has a spelled dot, or a spelled at sign before a host with a dot
        rf"{gap}{DOT_WORDS}{gap}", rf"{gap}{AT_WORDS}{gap}{{1,3}}[A-Za-z0-9-]{{1,63}}\.[A-Za-z0-9-]",
        # a number has a digit word next to another number, a spelled dot, or a spelled sign
        rf"{_DIGIT}{far}{point}(?:{_DIGIT}|[0-9])", rf"[0-9]{far}{point}{_DIGIT}", rf"[{space},.-](?:dot|point)[{space}-]", rf"plus[{space}-]{{1,3}}(?:{_DIGIT}|[0-9])",
    ))


SIGNS = re.compile(signs(r"\s"), re.I)
#: The same for whole Arrow batches, with what the plain detectors and the homoglyphs need; white space as Python's.
BATCH_SIGNS = "(?i)[0-9@" + re.escape("".join(homoglyphs())).replace("\\-", "\\x{2D}") + "]|" + signs(r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}")


def _number(m: re.Match) -> str | None:
    """A run with a spelled digit, dot or sign as digits, whatever its length: the detectors decide; a leading `plus` as its sign."""
    words = _WORDS.findall(m.group())
    if all(w[0] in "0123456789" for w in words):
        return None
    return "".join(DIGITS.get(w.lower(), {"dot": ".", "point": ".", "plus": "+"}.get(w.lower(), w)) for w in words)


def _spoken(m: re.Match) -> str | None:
    join = lambda s: re.sub(rf"\s+{DOT_WORDS}\s+", ".", s, flags=re.I)
    host, local = join(m["host"]), join(m["local"])
    plain = f"{local}@{host}"
    if plain == m.group() or host.rsplit(".", 1)[1].lower() not in DOMAINS:
        return None
    # "look at example.com" is prose: a bare word before a host that is spelled out in no part is no name
    return plain if host != m["host"] or "@" in m.group() or not local.isalpha() else None


TRANSDUCERS = (
    (GLYPHS, lambda m: homoglyphs()[m.group()]),
    (BRACKETED, lambda m: "@" if m["at"] else "."),
    (SPOKEN, _spoken),
    (NUMBER, _number),
)


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of the source whose identifiers show only, or show further, in the rewritten text."""
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    steps: list[Rewritten] = []
    now = text
    for pattern, replace in TRANSDUCERS:
        step = rewrite(now, pattern, replace)
        if step.text == now:
            continue
        steps.append(step)
        now = step.text
        for kind, spans in detect(now).items():
            for start, end in spans:
                touched = False
                for s in reversed(steps):
                    start, end, t = s.back(start, end)
                    touched |= t
                inside = any(a <= start and end <= b for a, b in (*plain[kind], *added[kind]))
                if touched and not inside:
                    added[kind] = [(a, b) for a, b in added[kind] if not (start <= a and b <= end)] + [(start, end)]
    return added


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added spans of one text, by kind."""
    plain = detect(text)
    if GLYPHS.search(text) or SIGNS.search(text):
        return plain, disguised(text, plain)
    return plain, {k: [] for k in KINDS}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """Each found span replaced by its kind; of overlapping spans the union."""
    marks = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    out, done = [], 0
    for a, b, k in marks:
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string"
EMPTY = (0, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _scan(texts: pa.Array, redact: bool) -> list[pa.Array]:
    texts = pc.fill_null(texts, "")
    maybe = pc.match_substring_regex(texts, BATCH_SIGNS).to_pylist()
    rows = []
    for i, yes in enumerate(maybe):
        row = (*EMPTY, None)
        if yes:
            text = texts[i].as_py()
            plain, added = find(text)
            every = {k: plain[k] + added[k] for k in KINDS}
            n = sum(map(len, added.values()))
            if n or any(plain.values()):
                row = (*(len(plain[k]) for k in KINDS), n, hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every), redacted(text, every) if redact else None)
        rows.append(row)
    kinds = [pa.int64()] * 5 + [pa.string()] * 3
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]


def scan(docs: DataFrame, redact: bool = True) -> DataFrame:
    """`docs` (text, ...) with counts of plain spans, their digest, all spans, and the redacted text (null: nothing to redact)."""
    return append(docs, FOUND, lambda batch: _scan(batch.column(batch.schema.get_field_index("text")), redact))


def op2_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), redact=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.col("n_added"))
