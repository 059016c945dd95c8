"""Sentence boundaries across languages and scripts by a pushdown automaton.

Lines are read first, by an automaton whose stack holds the open list levels: an item opens a level or goes on in one, deeper
levels close before it, and a line indented below an item's mark belongs to that item; a blank line closes all. Headings and
list items are units of their own. Each block of prose runs through an automaton whose stack holds the open quotations and
brackets; only with an empty stack can a terminator end a sentence. A trie of abbreviations, read backwards from a full stop, and
the script of the terminator decide whether it does. Offsets count code points. Both scans are linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, written without the inner spaces and the last full stop.
#: Never at the end of a sentence.
BEFORE = """e.g i.e cf vs viz resp mr mrs ms dr prof rev hon st mt messrs sen gov gen col capt lt sgt approx est ca z.b d.h u.a s.o
s.u v.a bzw vgl evtl ggf inkl exkl zzgl sog hr fr str env p.ex c.-à-d mme mlle mm p.ej secc sr sra srta dña aprox núm см рис
напр т.е стр тыс ул π.χ βλ δηλ डॉ श्री प्रो u.s u.k""".split()
#: An abbreviation before a number only.
COUNTED = "no nos nr sec fig figs vol vols p pp ch eq art par pág págs fol abs kap bd n° гл п".split()
#: Ends a sentence before a capital letter.
EITHER = "inc ltd corp co llc plc bros jr p.m a.m gmbh ag т.д т.п др г гг мин сек руб κ.λπ κ.ά κ.τ.λ ph.d b.a m.a".split()
#: Ends a sentence unless punctuation follows.
LAST = "etc usw u.s.w u.s.f usf".split()
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())

_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "“": "”", "„": "“”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", '"': '"', "＂": "＂"}
_CLOSERS = {c for v in _PAIRS.values() for c in v}
_THAI = "฀-๏๚-๿"
# Public tokenizers mark the border of two documents by the control token <|endoftext|>. In crawled text it is often torn, its signs lost
# or set apart; what is left of it (the word, a lone "<" before a new beginning) is no part of a sentence and stands for itself.
_TORN = r"(?<!\S)endoftext(?!\S)|(?<=\s)<(?=\s+(?:[A-ZÀ-Þ]|endoftext\b))"
_EVENT = re.compile(rf"{_TORN}|[.!?…。！？．؟।॥]+|;|[\"＂()\[\]{{}}«»‹›“”„「」『』（）【】《》〈〉［］]|(?<=[{_THAI}])[  ]+(?=[^\s0-9A-Za-z])|(?<=[^\s0-9A-Za-z])[  ]+(?=[{_THAI}])")
_LINE = re.compile(r"[^\r\n  \x85]*(?:\r\n|[\r\n  \x85])?")
_MARK = re.compile(r"[ \t ]*(?:[-*+•‣◦▪–—·]|\(?\d{1,3}[.)]|\(?[A-Za-z]\)|[①-⑳])[ \t ]+\S|[ \t ]*#{1,6}[ \t ]")
_BREAK = re.compile(r"[ \t]*(?:[-*•] \S|#{1,6} )")  # begins a list item or heading even right behind prose
_HEADING = re.compile(r"[ \t\u3000]*#{1,6}[ \t\u3000]")
_SPACE = re.compile(r"\s*")
_PROGRAM = re.compile(r"[a-z][a-z_-]* v?\d+\.\d")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|beim|im|der|die|das|den|dem|des|bis|ab|jeden)\s\d{1,2}$", re.I)
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")


def _trie() -> dict:
    root: dict = {}
    for kind, words in (("before", BEFORE), ("counted", COUNTED), ("either", EITHER), ("last", LAST)):
        for word in words:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node["kind"] = kind
    return root


_TRIE = _trie()
_PARTS = {w for words in (BEFORE, COUNTED, EITHER, LAST) for w in words if "." in w}
_NEXT_WORD = re.compile(r"[^\W\d_]+")


def _abbreviation(text: str, stop: int, start: int) -> str | None:
    """The kind of the longest abbreviation that ends before the full stop at ``stop``; spaces after inner stops are skipped."""
    node, i, kind = _TRIE, stop - 1, None
    while i >= start:
        c = text[i].lower()
        if c.isspace() and i > start and text[i - 1] == "." and "." in node:
            i -= 1
            continue
        node = node.get(c)
        if node is None:
            break
        if "kind" in node and (i == start or not text[i - 1].isalnum() and not (text[i - 1] in "._")):
            kind = node["kind"]
        i -= 1
    return kind


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _full_stop(text: str, stop: int, end: int, start: int) -> bool:
    """Whether the single full stop at ``stop`` ends a sentence; ``end`` is the end of its block."""
    j = stop + 1
    before = text[stop - 1] if stop > start else " "
    if j >= end:
        return True
    k = _skip(text, j)
    following = text[k] if k < end else ""
    if k == j:  # nothing between: only where a word has been joined to the last one
        follows = text[j + 1] if j + 1 < end else " "
        return following.isupper() and (follows.islower() or follows.isspace()) and (before.isalnum() or before in _CLOSERS or before in "'’") and not _abbreviation(text, stop, start)
    if not following:
        return True
    kind = _abbreviation(text, stop, start)
    if kind == "before":
        return False
    alone = stop - 2 < start or not (text[stop - 2].isalnum() or text[stop - 2] == "_")
    word = _NEXT_WORD.match(text, k)
    if word and alone and f"{before}.{word[0]}".lower() in _PARTS:
        return False  # within an abbreviation of several parts
    if kind == "counted":
        return not (following.isdigit() or following == "№")
    if kind == "either":
        return following.isupper() or following in _PAIRS or following in "¿¡"
    if kind == "last":
        return following not in ",;:)"
    if before.isalpha() and before.isupper() and alone and before.lower() != before and not (stop - 3 >= start and text[stop - 2].isspace() and text[stop - 3].isdigit()):
        return False  # an initial
    if alone and before.isalpha() and word and len(word[0]) == 1 and text[k + 1 : k + 2] == "." and k + 1 < end:
        return False  # initials in lower case
    if before.isdigit() and following.islower():
        return bool(_PROGRAM.match(text, k))
    if before.isdigit() and following.isupper():
        number = re.search(r"(?<![\w.,])\d{1,2}$", text[max(start, stop - 4) : stop])
        word = re.match(r"\w+", text[k:end])
        if number and (word and word[0].lower() in MONTHS or _ORDINAL.search(text, max(start, stop - 10), stop)):
            return False
    return True


def _after_closing(text: str, k_end: int, end: int, inner: str, comma: bool) -> bool:
    """Whether a sentence ends with the closing mark that ends at ``k_end`` and follows the terminator ``inner``."""
    k = _skip(text, k_end)
    if k >= end:
        return True
    c = text[k]
    if k == k_end:
        follows = text[k + 1] if k + 1 < end else " "
        return c.isascii() and text[k_end - 1].isascii() and c.isupper() and (follows.islower() or follows.isspace())
    if c.isupper() or c in "¿¡" or c in _PAIRS:
        return True
    if inner[-1] == "." and (c.isdigit() or c.islower() and (comma or _PROGRAM.match(text, k))):
        return True
    return False


class _Stack:
    """Open quotations and brackets; where each closing mark would lead is kept per mark, so closing costs what it removes."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, closers: str, comma: bool) -> None:
        for c in closers:
            self.places.setdefault(c, []).append(len(self.open))
        self.open.append((closers, comma))

    def close(self, mark: str) -> bool | None:
        """Close what ``mark`` closes, and all within; whether a comma stood before it, or None if it closes nothing."""
        at = self.places.get(mark)
        if not at:
            return None
        at = at[-1]
        comma = self.open[at][1]
        while len(self.open) > at:
            for c in self.open.pop()[0]:
                self.places[c].pop()
        return comma


def _block(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Sentences of the prose between ``start`` and ``end``."""
    stack = _Stack()
    begin, inner, inner_end = start, "", -1
    greek = None
    skip_to = start
    last: dict[str, int] = {}  # the last place of each closing mark in the block

    def closes_later(mark: str, at: int) -> bool:
        if mark not in last:
            last[mark] = text.rfind(mark, start, end)
        return last[mark] >= at

    def close(at: int) -> None:
        nonlocal begin, inner_end
        out.append((begin, at))
        begin, inner_end = _skip(text, at), -1

    for m in _EVENT.finditer(text, start, end):
        at, to, s = m.start(), m.end(), m[0]
        if at < skip_to:
            continue
        c = s[0]
        if c in _CLOSERS or c in _PAIRS:
            comma = stack.close(c)
            if comma is not None:
                if not stack.open and inner_end >= 0 and (inner_end == at or text[inner_end:at].isspace()) and _after_closing(text, to, end, inner, comma):
                    close(to)
            elif c in _PAIRS and any(closes_later(x, to) for x in _PAIRS[c]):
                lead = text[max(begin, at - 2) : at].rstrip()
                stack.push(_PAIRS[c], lead[-1:] in (",", ":"))
            continue
        if c in "  ":
            if not stack.open:
                close(at)
            continue
        if c == ";":
            if greek is None:
                greek = bool(_GREEK.search(text, start, end))
            if not greek or not (to >= end or text[to].isspace() or text[to] in _CLOSERS):
                continue
        if stack.open:
            inner, inner_end = s, to
            continue
        if s == ".":
            ends = _full_stop(text, at, end, begin)
        elif s.strip(".…") == "":  # an ellipsis
            k = _skip(text, to)
            ends = k >= end or k > to and (text[k].isupper() or text[k] in _PAIRS or text[k] in "¿¡")
        elif c in "。！？．؟।॥;":
            ends = True
        else:
            k = _skip(text, to)
            ends = k >= end or k > to or text[k].isupper() or text[k] in "¿¡"
        if ends:
            while to < end and text[to] in "'’)]»”" and not (to + 1 < end and text[to + 1].isalnum()):
                to += 1
            skip_to = to
            close(to)
    if begin < end:
        out.append((begin, end))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end (exclusive) of every unit of a text, in order, without surrounding white space."""
    if not text:
        return []
    units: list[tuple[int, int]] = []
    prose = at = 0
    open_ = False  # a block of prose is open
    levels: list[int] = []  # indents of the open list items, the innermost last

    def flush(to: int) -> None:
        nonlocal open_
        if open_:
            _block(text, prose, to, units)
        open_ = False

    while at < len(text):
        to = _LINE.match(text, at).end()
        line = text[at:to]
        indent = len(line) - len(line.lstrip(" \t\u00a0\u3000"))
        if not line.strip():
            flush(at)
            levels.clear()
        elif (_BREAK if open_ else _MARK).match(line):
            flush(at)
            units.append((at, to))
            while levels and levels[-1] >= indent:
                levels.pop()
            if not _HEADING.match(line):
                levels.append(indent)
        elif levels and indent > levels[-1]:
            units[-1] = (units[-1][0], to)  # a wrapped item goes on
        elif not open_:
            levels.clear()
            prose, open_ = at, True
        at = to
    flush(len(text))
    trimmed = []
    for a, b in units:
        piece = text[a:b]
        bare = piece.strip()
        if bare:
            a += len(piece) - len(piece.lstrip())
            trimmed.append((a, a + len(bare)))
    return trimmed


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, starts, ends = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            for x, y in sentences(text):
                rows.append(i)
                starts.append(x)
                ends.append(y)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "start_pos", "end_pos"])


def split_sentences(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit: ``row_id``, start_pos, end_pos. Null, empty and blank texts have none; a null id is kept as
    null; equal rows come out once each. Texts of any length are read whole, each by one linear scan; no shuffle."""
    kind = df.schema[row_id].dataType.simpleString()
    units = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_split, f"id {kind}, start_pos bigint, end_pos bigint")
    return units.select(F.col("id").alias(row_id), "start_pos", "end_pos")
