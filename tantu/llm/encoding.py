"""Problem 7: text decoded in the wrong encoding, found and restored by a best-first search over encodings."""

from __future__ import annotations

import codecs
import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Encodings in which bytes may have been read wrongly, and in which they may have been written besides UTF-8: fixed values.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "iso8859-2", "cp866", "koi8-r", "cp1254", "cp1253", "cp874", "cp1256")
READ_AS_CJK = ("gbk", "cp932", "big5", "cp949", "euc_jp")
#: Readings that leave an undefined byte as the C1 control of its number.
WITH_CONTROLS = frozenset(("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-15", "iso8859-2", "cp1254", "cp1253", "cp874", "cp1256"))
#: Older encodings in which bytes that are not UTF-8 may have been written, by the encoding they were read in.
WRITTEN_IN = {
    "cp1251": ("cp1252",),
    "cp1252": ("cp874", "cp1256", "cp1251"),
    "latin-1": ("cp874", "cp1256", "cp1251"),
    "mac_roman": ("cp1252",),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
}
#: What whole stretches may have been written in, by what they were read in; a stretch says more than a word.
STRETCH_READ_AS = ("latin-1", "cp1252", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_roman")
STRETCH_WRITTEN_IN = ("cp1251", "koi8-r", "iso8859-5", "cp866", "iso8859-7", "cp1253", "cp1255", "cp932", "euc_jp", "gbk", "big5", "euc_kr")
#: A step of the search costs so much, one through an older encoding so much more; a text counts as restored if its cost falls by MARGIN at least.
#: A way through texts that cost more than the best by DETOUR is given up.
STEP, OLDER, MARGIN, DETOUR = 0.25, 1.5, 0.6, 3.0
#: A whole page is read anew only if its cost falls by so much, and to less than this share, and if that gives so many letters of other alphabets.
STRETCH_MARGIN, STRETCH_SHARE, STRETCH_LETTERS = 3.0, 0.5, 12

#: Cyrillic and Greek letters that look like Latin ones: such a letter in a Latin word is a matter of spelling, not of encoding.
LOOK_ALIKE = frozenset("асеорхуіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԌαοιντυρκγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
QUOTES = frozenset("‘’“”„‚–—…•«»‹›€‐‑")
INVISIBLE = frozenset("\xad\xa0​‌‍‎‏   ⁠﻿")

#: Runs of more characters than this are not remembered.
LONG = 300

# what a piece of garbled text is made of: anything beyond ASCII that no script of its own accounts for
_OWN = "ऀ-ॿ꣠-ꣿ฀-๿؀-ۿݐ-ݿ　-ヿ㐀-鿿豈-﫿＀-￯︰-﹏⺀-⿟"
_QUIET = "‘’“”„‚–—…•«»‹›€‐‑\xad\xa0​-‏   ⁠﻿"
_RUN = re.compile(f"[A-Za-z]?[{_QUIET}]*[^\\x00-\\x7f{_OWN}{_QUIET}][^\\x00-\\x7f{_OWN}]*[A-Za-z]?")
_CJK = re.compile("[　-ヿ㐀-鿿豈-﫿＀-￯⺀-⿟-�‐-※·∀-◿Α-ё€]*[぀-ヿ㐀-鿿｡-ﾟ][　-ヿ㐀-鿿豈-﫿＀-￯⺀-⿟-�‐-※·∀-◿Α-ё€]*")
_SUSPECT, _IDEOGRAPH = re.compile(f"[^\\x00-\\x7f{_OWN}{_QUIET}]"), re.compile("[぀-ヿ㐀-鿿｡-ﾟ]")
_ENTITY = re.compile(r"&(?:#\d{2,7}|#x[0-9A-Fa-f]{2,6}|[A-Za-z]{2,8});")
_STRETCH = re.compile(f"[^\n{_OWN}]+")
_BEYOND, _VISIBLE = re.compile(r"[^\x00-\x7f]"), re.compile(r"\S")
_BYTES = re.compile("[\x00-\x08\x0e-\x1f]")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def _mark(error: UnicodeError) -> tuple[bytes, int]:
    """Undefined places: a C1 control is the byte of its number, anything else is a byte no text holds."""
    part = error.object[error.start : error.end]
    return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else b"\xff" for c in part), error.end


def _lose(error: UnicodeError) -> tuple[bytes, int]:
    return b"\xff" * (error.end - error.start), error.end


codecs.register_error("tantu-mark", _mark)
codecs.register_error("tantu-lose", _lose)


def _kind(c: str) -> tuple[float, str]:
    """Cost of a character, and its script for the cost of mixing."""
    o = ord(c)
    if o < 0x80:
        return (0.0, "L") if c.isalpha() else (2.0, "") if o < 32 and c not in "\n\t\r" else (0.0, "")
    if o < 0xA0:
        return 3.0, "?"
    if c == "�":
        return 2.0, "?"
    if c in "ƒˆ˜":
        return 1.0, "?"
    if c in QUOTES or c in INVISIBLE:
        return 0.15, ""
    if o <= 0xFF or o in (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E):
        return (0.35, "L") if c.isalpha() and c not in "ªº" else (1.0, "?")
    if o < 0x250:
        return 0.7, "L"
    if 0x370 <= o < 0x530:
        return (0.1, "") if c in LOOK_ALIKE else (0.12, "G" if o < 0x400 else "C") if o < 0x450 or o == 0x451 else (0.7, "C")
    if 0x05D0 <= o < 0x05EB:
        return 0.12, "H"
    if 0x0900 <= o < 0x0980:
        return 0.05, "D"
    if 0x0E01 <= o < 0x0E5C:
        return 0.05, "T"
    if 0x0600 <= o < 0x0700:
        return (0.05 if 0x621 <= o < 0x64B or 0x6F0 <= o < 0x6FA or c in "،؛؟ٹپچڈڑژکگںھہیےۂۃۓ۔" else 0.4), "A"
    if 0x3041 <= o < 0x3100:
        return 0.1, "J"
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return 0.1, ""
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0:
        return 0.4, "J"
    if 0xFF61 <= o < 0xFFA0:
        return 0.7, "J"
    return (1.5, "?") if 0xE000 <= o < 0xF900 else (1.0, "?")


_KINDS: dict[str, tuple[float, str]] = {}


def implausibility(text: str) -> float:
    """How unlikely it is that anyone wrote these characters.

    Costs of the characters, 1.5 for each change of script inside a word, 1 for a symbol against a letter and
    1.5 for a capital beyond ASCII after a small letter and for blanks beyond ASCII in a row.
    """
    total, before, last = 0.0, "", "."
    for c in text:
        k = _KINDS.get(c)
        if k is None:
            k = _KINDS[c] = _kind(c)
        total += k[0]
        script = k[1]
        if script and before and script != before:
            total += 1.5 if script != "?" and before != "?" else 1.0
        elif c > "\x7f" and (last.islower() and c.isupper() or last in INVISIBLE and c in INVISIBLE):
            total += 1.5
        before, last = script, c
    return total


#: The way a text went: what it was read as and written in, step by step.
Way = tuple[tuple[str, str], ...]


def _decoded(raw: bytes, read_as: str) -> Iterator[tuple[str, float, str]]:
    """Texts the bytes may stand for, what the step costs, and the encoding."""
    whole = raw.decode("utf-8", "replace")
    if 2 * whole.count("�") < len(whole):
        yield whole, STEP, "utf-8"
    if "�" in whole and b"\xff" not in raw:
        for name in WRITTEN_IN.get(read_as, ()):
            try:
                yield raw.decode(name), STEP + OLDER, name
            except UnicodeDecodeError:
                continue


def _encoded(text: str, name: str) -> bytes:
    return text.encode(name, "tantu-mark" if name in WITH_CONTROLS else "tantu-lose")


@lru_cache(20_000)
def search(text: str, readings: tuple[str, ...] = READ_AS) -> tuple[float, str, Way]:
    """(fall in cost, cheapest text reached, the encodings on the way; none if nothing was decoded).

    Nodes are texts and byte strings; edges encode a text in an encoding it may have been read in, decode
    bytes, or unescape entities. The cheapest node is expanded first and no state twice; the cost of a text
    is its implausibility and that of the steps to it, the cost of bytes what they promise.
    """
    start = implausibility(text)
    best, order = (start, text, ()), 0
    seen, seen_bytes = {hash(text)}, set()  # apart: a text and its bytes can hash alike
    heap: list[tuple[float, int, float, str | bytes, Way, str]] = [(start, order, 0.0, text, (), "")]
    while heap:
        cost, _, steps, state, way, read_as = heapq.heappop(heap)
        found: list[tuple[str, float, Way]] = []
        if isinstance(state, bytes):
            found = [(t, step, (*way, (read_as, name))) for t, step, name in _decoded(state, read_as)]
        else:
            if cost < best[0]:
                best = (cost, state, way)
            if cost > best[0] + DETOUR:
                continue
            if "&" in state:
                found = [(html.unescape(state), 0.0, way)]
            for name in readings:
                raw = _encoded(state, name)
                if raw.count(b"\xff") * 4 > len(raw) or (name not in WRITTEN_IN and hash(raw) in seen_bytes) or raw.isascii():
                    continue
                seen_bytes.add(hash(raw))
                order += 1
                try:  # bytes that are UTF-8 are the likely way on
                    raw.decode("utf-8")
                    promise = cost / 3
                except UnicodeDecodeError:
                    promise = cost
                heapq.heappush(heap, (promise, order, steps, raw, way, name))
        for t, step, on in found:
            if hash(t) not in seen:
                seen.add(hash(t))
                order += 1
                heapq.heappush(heap, (implausibility(t) + steps + step, order, steps + step, t, on, ""))
    return start - best[0], best[1], best[2]


def _better(run: str, cjk: bool) -> tuple[str, Way] | None:
    # long runs hardly recur and are not kept
    find = search if len(run) <= LONG else search.__wrapped__
    gain, text, way = find(run, READ_AS_CJK if cjk else READ_AS)
    # ideographs are many: what is merely a rarer reading of a few of them is none
    return (text, way) if way and gain >= (MARGIN + 0.02 * len(run) if cjk else MARGIN) else None


def _along(run: str, way: Way) -> str | None:
    """The run restored along a way that other runs of the page went; None where it doesn't lead on."""
    for read_as, written in way:
        try:
            run = _encoded(run, read_as).decode(written)
        except UnicodeDecodeError:
            return None
    return run


def _runs(text: str) -> Iterator[tuple[re.Match, bool]]:
    if _SUSPECT.search(text):
        for m in _RUN.finditer(text):
            yield m, False
    if _IDEOGRAPH.search(text):
        for m in _CJK.finditer(text):
            yield m, True


def _reread(text: str, read_as: str, written: str) -> str | None:
    try:
        return text.encode(read_as, "tantu-mark" if read_as in WITH_CONTROLS else "strict").decode(written)
    except UnicodeError:
        return None


def _whole_reread(text: str) -> tuple[float, str] | None:
    """(cost of the whole, text) with every stretch between letters of scripts of its own read in the one pair of encodings that suits the page best; None where none does.

    A word alone can be read in several ways; the words of a page are far less likely to be all of them words by chance.
    """
    # letters with accents are few among others; what was misread is hardly anything else
    stretches = Counter(t for m in _STRETCH.finditer(text) if _SUSPECT.search(t := m.group()) and 2 * len(_BEYOND.findall(t)) >= len(_VISIBLE.findall(t)))
    before = {t: implausibility(t) for t in stretches}
    cost = sum(n * before[t] for t, n in stretches.items())
    best: tuple[float, dict[str, str]] | None = None
    if cost > STRETCH_MARGIN:
        for read_as in STRETCH_READ_AS:
            for written in STRETCH_WRITTEN_IN:
                new = {t: r for t in stretches if read_as != written and (r := _reread(t, read_as, written)) is not None}
                after = sum(n * (implausibility(new[t]) if t in new else before[t]) for t, n in stretches.items()) + STEP + OLDER
                if new and (best is None or after < best[0]):
                    best = (after, new)
    elif _BYTES.search(text):
        cost, stretches = implausibility(text), Counter([text])
        for written in ("utf-16-le", "utf-16-be"):
            r = _reread(text, "latin-1", written)
            if r is not None and (best is None or implausibility(r) + STEP + OLDER < best[0]):
                best = (implausibility(r) + STEP + OLDER, {text: r})
    if best is None or best[0] >= STRETCH_SHARE * cost or cost - best[0] <= STRETCH_MARGIN:
        return None
    letters = sum(c > "\u024f" and c.isalpha() for t in best[1].values() for c in t)
    if letters < STRETCH_LETTERS:
        return None
    after = implausibility(text) - cost + best[0] - STEP - OLDER
    return after, best[1][text] if text in best[1] else _STRETCH.sub(lambda m: best[1].get(m.group(), m.group()), text)


def is_garbled(text: str, scan: bool) -> bool:
    """Whether some stretch was decoded wrongly, restorable or not. Single lost characters of a scan are no sign."""
    if text.isascii():
        return bool(_ENTITY.search(text)) and _restored_entities(text) != text or bool(_BYTES.search(text)) and _whole_reread(text) is not None
    if _CONTROL.search(text) or ("�" in text and (not scan or "��" in text)):
        return True
    return any(_better(m.group(), cjk) is not None for m, cjk in _runs(text)) or _whole_reread(text) is not None


def _restored_entities(text: str) -> str:
    """Entities that hide wrongly decoded characters; plain entities stay."""
    opened = html.unescape(text)
    return opened if any(_better(m.group(), cjk) is not None for m, cjk in _runs(opened)) else text


def restored(text: str) -> str:
    """The text with every restorable stretch restored; a stretch that no way makes more plausible stays.

    The way that restores most of the page is tried first on every stretch, so that short ones, which alone
    could be read in several ways, follow the others.
    """
    text = _restored_entities(text) if "&" in text else text
    whole, text = _whole_reread(text), _restored_runs(text)
    return whole[1] if whole is not None and whole[0] <= implausibility(text) else text


def _restored_runs(text: str) -> str:
    for pattern, cjk in ((_RUN, False), (_CJK, True)):
        runs = Counter(m.group() for m in pattern.finditer(text))
        ways = {better[1] for run in runs if (better := _better(run, cjk))}
        if not ways:
            continue
        if any(len(w) == 1 and w[0][1] == "utf-8" for w in ways):
            ways |= {((name, "utf-8"),) for name in (READ_AS_CJK if cjk else READ_AS)}

        def total(way: Way, runs: Counter = runs) -> float:
            return sum(n * implausibility(run if (t := _along(run, way)) is None else t) for run, n in runs.items())

        common = min(sorted(ways), key=total)

        def put(m: re.Match, cjk: bool = cjk, common: Way = common) -> str:
            run = m.group()
            t = _along(run, common)
            # that bytes are UTF-8 by chance is less likely than that a short run looks well
            if t is not None and t != run and (common[-1][1] == "utf-8" or implausibility(t) < implausibility(run)):
                return t
            better = _better(run, cjk)
            return better[0] if better else run

        text = pattern.sub(put, text)
    return text


def garbled_pages(pages: DataFrame, *, restore: bool = False) -> DataFrame:
    """(id[, text, restored]) of the pages with wrongly decoded text; one row for repeated rows.

    pages needs id, text and meta.origin. A null or empty text is not garbled, a null origin is no scan, a
    null id is kept as null. Pages are judged where they are read, one by one and whole.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, origins = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = [i for i, t in enumerate(texts) if t and is_garbled(t, origins[i] == "scan")]
            ids = b.column(0).take(pa.array(hit, pa.int64()))
            if restore:
                yield pa.RecordBatch.from_arrays(
                    [ids, b.column(1).take(pa.array(hit, pa.int64())), pa.array([restored(texts[i]) for i in hit], pa.string())],
                    names=["id", "text", "restored"],
                )
            else:
                yield pa.RecordBatch.from_arrays([ids], names=["id"])

    rows = pages.select("id", "text", F.col("meta.origin").alias("origin"))
    found = rows.mapInArrow(judge, "id string, text string, restored string" if restore else "id string")
    return found.distinct()
