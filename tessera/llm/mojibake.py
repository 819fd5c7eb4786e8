"""Text decoded with the wrong character encoding (best-first search over encode, decode and unescape).

A text is searched run by run, a run being a stretch of non-ASCII characters or of HTML character references. A
state is a text; from each state one step may encode it in a legacy encoding and decode the bytes as UTF-8
(wherever the bytes form whole UTF-8 sequences, so a text damaged in part is put right in part), encode it in one legacy encoding and
decode it in another (once on a way, whole runs of some length), unescape HTML, restore the case of lead characters in a text that was lower-cased, or restore a no-break space that became a
blank. States wait in a heap ordered by how implausible their characters are, states seen before are skipped by
their hash, and the cheapest state reached is the answer. Every decoding of UTF-8 shortens the text and the others stand
once on a way, so the search ends by itself.

A text is damaged if the way to the cheapest state of some run holds a decoding, or if it holds signs of damage
that nothing undoes: U+FFFD, C1 control characters, or the remains of a three-byte sequence inside a word.

Defined cases: null, empty and pure ASCII texts without character references are not damaged; signs between
back-ticks are quoted, not damage, unless the back-ticks are a string of code (an operator, bracket or ``return`` before a long one); a byte-order mark (U+FEFF) alone is none; what can't be undone stays as it is.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

#: Encodings tried, most frequent first; a later one must give a cheaper text to win.
CODECS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r")
#: A repair must lower the cost by so much, else the text stays.
MARGIN = 0.8
#: Runs and their answers kept by a Python worker.
CACHE = 1 << 16


def _characters(codec: str) -> dict[int, str]:
    """Byte -> the characters it may have become; bytes without one in cp1252 also as C1 controls."""
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            table[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            table[b] = ""
        if codec == "cp1252" and chr(b) not in table[b]:
            table[b] += chr(b)
    return table


class _Transcoder:
    """encode(wrong) then decode(right) of a whole text; the text itself where that is impossible."""

    def __init__(self, wrong: str, right: str):
        self.name, self.wrong, self.right = f"{wrong}>{right}", wrong, right

    def __call__(self, s: str) -> str:
        try:
            return s.encode(self.wrong).decode(self.right)
        except UnicodeError:
            return s


def _pattern(table: dict[int, str]) -> re.Pattern:
    """UTF-8 sequences of two to four bytes, in the characters of ``table``."""
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi) for c in table[b]) + "]"
    tail = cls(0x80, 0xC0)
    forms = [cls(0xF0, 0xF5) + tail + "{3}", cls(0xE0, 0xF0) + tail + "{2}", cls(0xC2, 0xE0) + tail]
    return re.compile("|".join(f for f in forms if "[]" not in f))


class _Decoder:
    """encode(codec) then decode(UTF-8), wherever that is possible in a text."""

    def __init__(self, codec: str, lowered: bool = False):
        table = _characters(codec)
        if lowered:  # lead characters as a lower-casing left them
            tails = {c for b, s in table.items() if b < 0xC0 for c in s}
            free = lambda s: "".join(c.lower() for c in s if c.lower() not in tails)
            table = {b: ("".join(c.lower() for c in s if c.lower() != c) if b >= 0xC2 else s + free(s)) for b, s in table.items()}
        self.name = f"{codec}{'+case' if lowered else ''}"
        self.bytes = {c: b for b, s in table.items() for c in s}
        self.pattern = _pattern(table)

    def _decode(self, m: re.Match) -> str:
        try:
            return bytes(self.bytes[c] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()

    def __call__(self, s: str) -> str:
        return self.pattern.sub(self._decode, s)


_DECODERS = [_Decoder(c) for c in CODECS]
#: Single-byte encodings taken for one another, (read as, written in), and the least run they are tried on.
_TRANSCODERS = [_Transcoder(*p) for p in (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"))]
TRANSCODED = 4
_LOWERED = [_Decoder(c, True) for c in ("cp1252", "cp437", "cp850", "mac_roman", "cp1251")]

#: Signs that are common in prose and code, by what they cost.
_PLAUSIBLE = dict.fromkeys("’‘“”„‚–—…«»¿¡·•§©®°±½¼¾µ²³×÷€£¥™√≤≥≠≈∞→←↑↓⇒✓✔✗\u00a0\u2003\u200d\ufe0f\ufeff\u0300\u0301\u0308", 1.0)
# Frequencies of the Russian letters in per cent.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.7, 6.26, 5.47, 4.73, 4.54, 4.4, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.9, 1.74, 1.7, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True))
_ENTITY_RUN = r"(?:&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});)+"
_RUN = re.compile(rf"[^\x00-\x7f]+|{_ENTITY_RUN}")
_QUOTED = re.compile(r"`[^`\n]+`")
_CODE_BEFORE = re.compile(r"(?:[=(\[{,:+>?|&!]|\breturn|\$)\s*$")
_NBSP = re.compile(r"(?<=[ÃÂ]) (?=\S)")
_RUSSIAN_WORDS = re.compile(r"(?:[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+)(?:[-—«» ](?:[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+))*")
_BOX = re.compile(r"[\u2500-\u257f]*[─━═][\u2500-\u257f]*|[│┃║]+")
_TORN = re.compile(r"[A-Za-z]â(?:t|s|re|ll|ve|d|m)\b")
_HOPELESS = re.compile(r"[\ufffd\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=4096)
def _char_cost(c: str) -> float:
    """How implausible one character is, by its block."""
    o = ord(c)
    if o < 0x80:
        return 1.5 if c == "&" else 0.0  # a character reference
    if c in _PLAUSIBLE:
        return _PLAUSIBLE[c]
    if o == 0xFFFD or 0x80 <= o < 0xA0:
        return 10.0
    if 0xC0 <= o < 0x180:  # Latin letters with marks
        return 1.0
    if 0x400 <= o < 0x460:  # Cyrillic: letters of Russian are cheap among themselves
        # a frequent letter is cheap, a rare one dear: 0.3 on average, a capital a little more
        f = _RUSSIAN.get(c.lower())
        return 0.05 + 0.06 * min(7.0, -log2(f / 100)) + (0.05 if c.isupper() else 0.0) if f else 1.5
    if 0x370 <= o < 0x400 or 0x5D0 <= o < 0x5EB or 0x620 <= o < 0x66A:
        return 0.9
    if 0x3040 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0x3000 <= o < 0x3003 or 0xFF00 <= o < 0xFF66:
        return 0.5
    if 0x1F300 <= o < 0x1FB00 or 0x2600 <= o < 0x27C0:
        return 1.0
    if 0xA1 <= o < 0xC0:
        return 1.3
    if 0x2500 <= o < 0x25A0:
        return 2.0
    return 6.0


def cost(s: str) -> float:
    """Implausibility of a text; letters of two scripts side by side add to it."""
    total, last = 0.0, ""
    for c in s:
        total += _char_cost(c)
        kind = "c" if "Ѐ" <= c < "Ѡ" else "l" if c.isalpha() and c < "ɐ" else "g" if "Ͱ" <= c < "Ѐ" else ""
        if kind and last and kind != last:
            total += 1.0
        last = kind
    return total


@lru_cache(maxsize=CACHE)
def search(run: str, lowered: bool = False, beside: str = "", known: str = "", swapped: bool = False) -> tuple[str, tuple[str, ...]]:
    """Cheapest text reachable from ``run`` and the operations on the way.

    ``beside`` is a Latin letter if one stands next to the run, ``known`` the decoding found elsewhere in the
    text, which then needs no margin; ``swapped`` adds the single-byte encodings taken for one another, whose result must be words.
    """
    if _BOX.fullmatch(run):
        return run, ()
    decoders = _DECODERS + _LOWERED if lowered else _DECODERS
    start = cost(beside + run)
    best = (start, 0, run, ())
    heap, seen, serial = [(start, 0, 0, run, ())], {hash(run)}, 0
    while heap:
        at, depth, _, text, way = heapq.heappop(heap)
        if (at, depth) < best[:2]:
            best = (at, depth, text, way)
        steps = [(d.name, d(text)) for d in decoders]
        if swapped and not way:
            steps += [(t.name, new) for t in _TRANSCODERS if (len(text) >= TRANSCODED or t.name == known) and _RUSSIAN_WORDS.fullmatch(new := t(text))]
        if "&" in text:
            steps.append(("unescape", html.unescape(text)))
        for name, new in steps:
            if hash(new) not in seen:
                seen.add(hash(new))
                serial += 1
                heapq.heappush(heap, (cost(beside + new), depth + 1, serial, new, (*way, name)))
    if any(s != "unescape" for s in best[3]) and (best[0] <= start - MARGIN or known and known in best[3]):
        return best[2], best[3]
    return run, ()


def examine(text: str | None) -> tuple[bool, str | None, str]:
    """(damaged, restored text, operations) of one text."""
    if not text or (text.isascii() and "&" not in text):
        return False, text, ""
    lowered = text == text.lower()
    quoted = [m.span() for m in _QUOTED.finditer(text) if m.end() - m.start() <= 18 and " " not in m.group() or not _CODE_BEFORE.search(text, max(0, text.rfind("\n", 0, m.start())), m.start())] if "`" in text else []
    inside = lambda p: any(a <= p < b for a, b in quoted)
    used: dict[str, None] = {}

    def put_right(s: str, outside: bool, known: str = "", swapped: bool = False) -> str:
        def one(m: re.Match) -> str:
            if outside and quoted and inside(m.start()):
                return m.group()
            a, b = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
            new, way = search(m.group(), lowered, "a" if a.isalpha() or b.isalpha() else "", known, swapped)
            if way:
                used.update(dict.fromkeys(way))
            return new

        return _RUN.sub(one, s)

    restored = put_right(text, True)
    if used:  # the text is damaged: what was doubtful before is settled by the decoding found
        known = next(o for o in used if o != "unescape")
        restored = put_right(text, True, known)
        if _NBSP.search(restored):
            restored = put_right(_NBSP.sub("\u00a0", restored), False, known)
    else:  # no UTF-8 was read wrongly: perhaps one single-byte encoding was read as another
        restored = put_right(text, True, "", True)
        if used:
            restored = put_right(text, True, next(o for o in used if o != "unescape"), True)
    damaged = bool(used)
    if not damaged:
        damaged = any(not inside(m.start()) for p in (_HOPELESS, _TORN) for m in p.finditer(text))
    return damaged, restored, " ".join(used)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("operations", pa.string())])


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            damaged, restored, way = examine(text)
            if damaged:
                rows.append((doc, restored, way))
        cols = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def damaged(docs: DataFrame) -> DataFrame:
    """``doc_id, restored, operations`` of the damaged rows of ``doc_id, text``; texts never leave their task.

    Pure ASCII texts without character references are dropped before they reach Python.
    """
    some = docs.where("text rlike '[^\\\\x00-\\\\x7f]' or text like '%&%;%'")
    return some.select("doc_id", "text").mapInArrow(_examine, "doc_id bigint, restored string, operations string")
