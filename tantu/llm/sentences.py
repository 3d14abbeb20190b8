"""Problem 6: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Abbreviations after which a sentence goes on, by script, and those that may also end one.
LATIN_ABBREVIATIONS = {
    "": "dr prof st no nr p vol vs ca max min ed eds op cf approx ph.d jr sr tel".split(),
    "en": "mr mrs ms messrs pp fig figs e.g i.e sgt cpl lt maj gen col capt cmdr adm gov pres sen rep rev hon supt dept est inc ltd corp bros co assn univ ave blvd rd mt ft jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun viz al".split(),
    "de": "bzw z.b d.h u.a vgl s bd bde abb hrsg sog str geb evtl ggf inkl exkl mio mrd hr fr frl dipl ing jh jhd kap abs art aufl anm ebd gest verh gegr okt dez mär sept jan feb apr jun jul aug nov u.ä o.ä i.d.r z.t v.a s.o s.u".split(),
    "fr": "m mm mme mmes mlle me av bd chap éd env fig janv févr avr juil sept oct nov déc p.ex c.-à-d".split(),
    "es": "sr sra srta ud uds vd av avda cap ej pág págs núm ene abr ago dic p.ej ee.uu".split(),
}
#: Common words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is was that it for with".split(), "de": "der die das und den dem ist nicht ein eine".split(),
    "fr": "le la les des et est une dans que pas".split(), "es": "el los las del y es una que por con".split(),
}
ENDING_ABBREVIATIONS = frozenset("a.m p.m b.c a.d etc usw b.c.e c.e u.s u.k".split())
DEVANAGARI_ABBREVIATIONS = frozenset(
    "डॉ प्रा श्री श्रीमती सौ कु पं स सं ता इ ई इ.स ई.स इ.स.पू ई.पू रु क्र पृ उदा कि.मी कि.ग्रॅ से.मी मि वि अ.क्र चि मा ले क".split()
) - {"क"}
THAI_ABBREVIATIONS = ("พ.ศ.", "ค.ศ.", "ดร.", "น.", "ม.", "กม.", "จ.", "อ.", "ต.", "ถ.", "รศ.", "ผศ.", "ศ.", "น.ส.", "ด.ช.", "ด.ญ.")
#: Words that take up quoted speech where letters have no case.
ATTRIBUTION = frozenset("असे असं असा अशी ऐसा ऐसे ऐसी म्हणत म्हणाला म्हणाली कहकर इति".split())
#: Speech of up to so many words at the start of a sentence belongs to it where nothing else tells.
SHORT_SPEECH = 3

#: Characters behind a candidate that are looked at, and before it for a list mark, blanks that lead to them not counted.
AHEAD, MARK = 160, 24

_INVISIBLE = "­​-‏⁠﻿‪-‮"
_BLANK = regex.compile(rf"\n[\s{_INVISIBLE}]*\n")
_WIDE = "。！？｡．"
_TERM = rf"[\p{{SB=STerm}}\p{{SB=ATerm}}…]"
#: The last is a terminator (no full stop) directly before a letter, with any quotes between.
_CANDIDATE = regex.compile(
    rf"(?P<t>{_TERM}[{_INVISIBLE}]*(?:{_TERM}[{_INVISIBLE}]*)*)(?P<c>[\p{{SB=Close}}{_INVISIBLE}]*)(?=\s|$)|(?P<t>[{_WIDE}]+)(?P<c>[”’』」》）】〉〕]*)"
    rf"|(?P<t>\p{{SB=STerm}}[\p{{SB=STerm}}{_INVISIBLE}]*)(?P<c>[\p{{SB=Close}}{_INVISIBLE}]*)(?P<tight>)(?=\p{{L}})"
)
_VISIBLE_END = regex.compile(rf"[\s{_INVISIBLE}]*$")
_LEAD = regex.compile(rf"[\s{_INVISIBLE}]*")
_WORD_BEFORE = regex.compile(r"[^\s(\[{“\"‘«„']+$")
_STRIP = regex.compile(f"[{_INVISIBLE}]")
_THAI_GAP = regex.compile(r"(?<=\S)[^\S\n]+(?=\S)")
_OPENING = frozenset("\"'“‘«„‚(「『《（[{‹»")
_SINGLE = regex.compile(r"\p{L}\p{M}*$")
_LIST_MARK = regex.compile(r"[(\[]?(?:[\p{Nd}]{1,3}|\p{L}\p{M}*)[.)\]]*$")
_PAIR_AFTER = regex.compile(r"\s+\p{L}\p{M}*\.(?=\s|$)")
_PAIR_BEFORE = regex.compile(r"(?:^|\s)\p{L}\p{M}*\.\s+$")
_FUNCTION = {k: regex.compile(r"\b(?:" + "|".join(w) + r")\b") for k, w in FUNCTION_WORDS.items()}
_ABBREVIATIONS = {k: frozenset(LATIN_ABBREVIATIONS[""]) | frozenset(w) for k, w in LATIN_ABBREVIATIONS.items() if k} | {"": frozenset(x for w in LATIN_ABBREVIATIONS.values() for x in w)}
_LATIN = regex.compile(r"\p{Latin}")
_ATTRIBUTION_WORD = regex.compile(r"[\p{L}\p{M}]+")
_THAI = regex.compile(r"\p{Thai}")
_NOT_SPEECH = regex.compile(rf"[{_INVISIBLE}]*")
_IN_WORD = regex.compile(r"[a-zß-ÿ][!?][a-zß-ÿ]")
#: Quotes that close always, and those that close what these opened, or else open.
_CLOSING = frozenset("”’)]}›")
_OPENED_BY = {"»": "«", "«": "»", "“": "„", "‘": "‚", "‹": "›"}


def latin_language(text: str) -> str:
    """The language whose function words are the most, more than two; "" where none are, so that the abbreviations of all count."""
    if not _LATIN.search(text):
        return ""
    found = {k: len(r.findall(text)) for k, r in _FUNCTION.items()}
    best = max(found, key=found.get)
    return best if found[best] > 2 else ""


def _closed(p: str, m: regex.Match) -> int:
    """The candidate's end with the quotes that close; directly before a letter some may open what follows."""
    end = m.end("t")
    if m.group("tight") is None:
        return m.end()
    before = p[:end]
    for k, c in enumerate(m.group("c"), end + 1):
        if c in "\"'":
            closes = len(regex.findall(rf"{c}(?<!\w{c}(?=\w))", before)) % 2
        else:
            closes = c in _CLOSING or c in _OPENED_BY and before.count(_OPENED_BY[c]) > before.count(c)
        if closes:
            end = k
        elif c not in _INVISIBLE:
            break
    return end


def _goes_on(p: str, start: int, m: regex.Match, end: int, lang: str) -> bool:
    """Whether the sentence that began at ``start`` of the paragraph goes on behind the candidate that ends at ``end``."""
    mark, closing = _STRIP.sub("", m.group("t")), _STRIP.sub("", p[m.end("t") : end])
    if m.group("tight") is not None and _IN_WORD.fullmatch(p[max(0, m.start() - 1) : m.end() + 1]):
        return True
    lead = _LEAD.match(p, end).end()
    after, follow = p[end : lead + AHEAD], p[lead : lead + AHEAD]
    if not follow:
        return False
    first = follow[0]
    bare = follow.lstrip("\"'“‘«„(")
    head = bare[:1] or first
    if closing:
        return _speech_goes_on(p, start, m, follow)
    if mark[0] in _WIDE:
        return False
    before = p[start : m.start("t")]
    if "…" in mark and (not before or before[-1].isspace()):
        return True
    if mark != ".":
        return mark.startswith("...") and head.islower()
    word = _STRIP.sub("", w.group()) if (w := _WORD_BEFORE.search(before)) else ""
    bare_start = _LEAD.match(before).end()
    whole = _STRIP.sub("", before[bare_start:]).strip() if len(before) - bare_start <= MARK else ""
    if whole and _LIST_MARK.match(whole) and (whole[-1:].isdigit() or len(whole.strip("([)]")) <= 2 and _SINGLE.match(whole.strip("([)]"))):
        return True
    if not word:
        return False
    last = word[-1]
    if last.isdigit():
        return lang == "de" and word.isdigit() and len(word) <= 2 and not before.endswith("S. " + word)
    if "\u0e00" <= last <= "\u0e5b":
        return True
    if "ऀ" <= last <= "ॿ":
        if word in DEVANAGARI_ABBREVIATIONS or regex.fullmatch(r"(?:\p{L}\p{M}*\.)+\p{L}\p{M}*", word):
            return True
        if _SINGLE.match(word):
            return bool(_PAIR_AFTER.match(after) or _PAIR_BEFORE.search(before[: len(before) - len(w.group())]))
        return False
    if last.isalpha() and last < "ɐ":
        low = word.lower()
        if low in ENDING_ABBREVIATIONS:
            return not head.isupper()
        if low in _ABBREVIATIONS[lang] or len(word) == 1 and (word.isupper() or lang == "de") or regex.fullmatch(r"(?:\p{L}\.)+\p{L}", word):
            return True
        return head.islower()
    return False


def _speech_goes_on(p: str, start: int, m: regex.Match, follow: str) -> bool:
    """Behind a closed quotation or bracket: on, if it was opened inside the sentence, or if the words behind take it up."""
    sentence = p[start : m.start("t")]
    sentence = sentence[_LEAD.match(sentence).end() :]
    first = follow[0]
    if first in ",;，、；،":
        return True
    if m.group("t")[0] in _WIDE or "぀" <= first <= "鿿":
        # East Asian speech is taken up unless it was a sentence of its own
        opened = sentence[:1] in "「『“‘《（"
        return first in "とのとがはをにもで" or not opened or "。" not in m.group("t")
    opener = sentence[:1]
    if opener not in _OPENING:
        # something stands before the quotation, or it holds several sentences; if it was opened in this one, it is part of it
        return any(c in _OPENING and (i == 0 or sentence[i - 1].isspace()) for i, c in enumerate(sentence))
    words = sentence[1:].split()
    if opener == "(":
        return first.islower()
    if any(w[0] in _OPENING for w in words[1:] if w) and not sentence[1:2] in _OPENING and opener in "\"'":
        return True
    if first.islower():
        return True
    word = _ATTRIBUTION_WORD.match(_STRIP.sub("", follow))
    if word and word.group() in ATTRIBUTION:
        return True
    mark = _STRIP.sub("", m.group("t"))
    if len(words) == 1 and mark[0] in "!?؟":
        return True
    if first.isupper():
        return False
    devanagari_ends = _DEVANAGARI_VERB.search(sentence)
    return len(words) <= SHORT_SPEECH and mark[0] in "!?؟" and not devanagari_ends


_DEVANAGARI_VERB = regex.compile(r"(?:आहे|आहेत|होता|होती|होते|असते|असेल|नाही|है|हैं|था|थी|थे|ہے|ہیں|تھا|تھی|تھے|گیا|لکھا|پڑھا|دیکھا)\s*$")


def _thai_stop(p: str, m: regex.Match) -> bool:
    """Whether a space ends a Thai sentence: not if it touches a figure, an abbreviation, Latin letters or the repetition mark."""
    before, behind = _STRIP.sub("", p[max(0, m.start() - 8) : m.start()]), _STRIP.sub("", p[m.end() : m.end() + 8])
    if not before or not behind:
        return False
    a, b = before[-1], behind[0]
    if a.isdigit() or b.isdigit() or a == "ๆ" or b == "ๆ" or a.isascii() and a.isalpha() or b.isascii() and b.isalpha() or a == ".":
        return False
    if b in "(" or a in "(,;:":
        return False
    return not any(behind.startswith(x) for x in THAI_ABBREVIATIONS)


def sentence_ends(text: str) -> list[int]:
    """End of every sentence: the number of characters through its last visible one."""
    ends: list[int] = []
    lang = latin_language(text)
    at = 0
    for gap in [*_BLANK.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        p = text[at:stop]
        start, last = 0, len(p) - len(_VISIBLE_END.search(p).group())
        if last > 0:
            marks = [(_closed(p, m), m, True) for m in _CANDIDATE.finditer(p)]
            if _THAI.search(p):
                marks += [(m.start(), m, False) for m in _THAI_GAP.finditer(p)]
                marks.sort(key=lambda x: x[0])
            for end, m, term in marks:
                if end > last or m.start() < start or end <= start:
                    continue
                if term and not _goes_on(p, start, m, end, lang) or not term and _thai_stop(p, m):
                    shown = end - len(_VISIBLE_END.search(p[start:end]).group())
                    if shown > start:
                        ends.append(at + shown)
                    start = end
            if not ends or ends[-1] < at + last:
                ends.append(at + last)
        if gap:
            at = gap.end()
    return ends


def sentence_bounds(pages: DataFrame, *, with_text: bool = False) -> DataFrame:
    """(id, end_pos[, sent_no, sentence]) of every page; distinct, so repeated rows are one page.

    Sentence-break properties of the characters give the candidates: terminators of all scripts with the
    closing quotes and brackets behind them, blank lines, and spaces in Thai. Behind a terminator other than
    a full stop a letter may follow without a space. Suppressed are abbreviations, initials, ordinals and
    list marks, ``!`` and ``?`` inside Latin words, and ends of quoted speech that the sentence takes up. A null or
    blank text has no sentence; texts of any length are judged whole.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, numbers, parts = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = 0
                for n, end in enumerate(sentence_ends(t) if t else ()):
                    ids.append(i)
                    pos.append(end)
                    if with_text:
                        numbers.append(n)
                        parts.append(t[start:end].strip())
                    start = end
            columns = [pa.array(ids, pa.string()), pa.array(pos, pa.int32())]
            if with_text:
                columns += [pa.array(numbers, pa.int32()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "end_pos", "sent_no", "sentence"][: len(columns)])

    return pages.select("id", "text").distinct().mapInArrow(split, "id string, end_pos int" + ", sent_no int, sentence string" * with_text)
