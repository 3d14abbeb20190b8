"""Problem 2: noise in text read from page images: cut words, misread characters, running heads, page numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tantu.session import materialise, shuffle_partitions

#: Different edge lines of one document that are compared in one task with as many.
LINES_AT_ONCE = 1024
#: A form counts as a misreading of a word that so many clean pages have, if it is itself found in at most one clean page for so many of those.
LEAST_PAGES, RATIO = 2, 25
#: Up to so many bytes of misread forms, with what they mean, are sent to all tasks; beyond that they are joined by a shuffle.
MOST_BROADCAST = 32_000_000
SAME_HEAD = 0.8
#: The words a chapter's name has at most, its number among them, and in how many documents and with how many numbers it is found.
CHAPTER_WORDS, CHAPTER_DOCS = 3, 3

# What characters are taken for in scans (right: what is read), marks of a cut word, words of heads and page numbers.
MISREAD = {
    "स": ("रा",), "र": ("२",), "ल": (
        "त्न",
    ), "ि": ("ी",), "म": ("भ",), "व": ("ब",), "न": ("त",), "प": ("ष",), "ध": ("घ",), "ट": ("ठ",), "ख": ("रव",), "ण": ("रण",), "ड": ("ङ",),
    "e": ("c",), "n": (
        "ri",
    ), "o": ("0",), "t": ("f",), "ü": ("ii",), "u": ("ii",), "l": ("1",), "m": ("rn",), "h": ("b",), "s": ("5",), "w": ("vv",), "ß": ("b",), "d": ("cl",),
}
LOSABLE = "ंँ"
SUFFIXES = ("पासून", "मध्ये", "साठी", "च्या", "तून", "कडे", "वाला")
HYPHENS = "-‐‑‒–­¬−"
PAGE_WORDS = ("पृष्ठ", "पान", "पृ", "page", "seite", "p", "s", "pg")
DIGITS = {c: str(i % 10) for i, c in enumerate("0123456789०१२३४५६७८९")} | dict(zip("oOlISsBr", "00115580", strict=True))

#: What cannot stand in a word unless it was read wrongly: lost characters, strokes for vowel signs, figures for letters.
SPOILT = "|".join([
    r"[\p{L}\p{M}]\x{FFFD}|\x{FFFD}[\p{L}\p{M}]",
    r"[\x{0900}-\x{097F}][|~^]",
    r"[a-zß-ÿ]![a-zß-ÿ]",
    r"[a-zß-ÿ][015](?!\p{Nd}|\.\p{L})",
    r"(?<![\p{Nd}\p{L}.,])[015](?!st|th|nd|rd)[a-zß-ÿ]{2}",
    r"[\x{0904}-\x{0963}]\x{0968}(?!\p{Nd}|\.\p{L})",
    r"(?<![\p{Nd}\p{L}\p{M}.,])\x{0968}[\x{0904}-\x{0939}][\p{M}\x{0904}-\x{0939}]",
])
#: A character each of these has.
SPOILT_SIGN = r"[015|~^!\x{0968}\x{FFFD}]"
#: The same as readings of single characters, for the repair.
STROKES = (
    (r"(?<=[\u0900-\u097f])\|", "ा"),
    (r"(?<=[\u0900-\u097f])~", "े"),
    (r"(?<=[\u0900-\u097f])\^", "ी"),
    (r"(?<=[\u0904-\u0963])\u0968(?=[\u0904-\u0963])", "र"),
    (r"(?<=[a-zß-ÿ])!(?=[a-zß-ÿ])", "i"),
    (r"(?<=[a-zß-ÿ])0(?=[a-zß-ÿ])", "o"),
    (r"(?<=[a-zß-ÿ])1(?=[a-zß-ÿ])", "l"),
    (r"(?<=[a-zß-ÿ])5(?=[a-zß-ÿ])", "s"),
)

WORD = r"[\p{L}\p{M}\p{Nd}‌‍�]+"
INVISIBLE = "​‎‏⁠﻿"


def misreadings(word: str) -> set[str]:
    """Every form a scan may make of the word by reading one place wrongly or losing one nasal mark."""
    out = set()
    for k, c in enumerate(word):
        for wrong in MISREAD.get(c, ()):
            out.add(word[:k] + wrong + word[k + 1 :])
        if c in LOSABLE and k:
            out.add(word[:k] + word[k + 1 :])
    out.discard(word)
    return out


_WRONG_SUFFIX = sorted({(w, s) for s in SUFFIXES for w in misreadings(s) if len(w) >= 3 and w not in SUFFIXES})


def _where(text: F.Column, sign: str, changed: F.Column) -> F.Column:
    """changed where the text has one of the signs, which are rare: looking for them costs less than replacing."""
    return F.when(text.rlike(sign), changed).otherwise(text)


def _plain(text: str) -> F.Column:
    """The text in lower case without invisible characters, soft hyphens only where they cut a line's last word."""
    c = F.lower(F.col(text))
    c = _where(c, f"[{INVISIBLE}]", F.translate(c, INVISIBLE, ""))
    return _where(c, "\u00ad", F.regexp_replace(c, "\u00ad(?!\n)", ""))


def _strokes_read(text: F.Column) -> F.Column:
    """Strokes read as the vowel signs they stand for, so that they divide no word."""
    out = text
    for stroke, sign in ((r"\|", "ा"), ("~", "े"), (r"\^", "ी")):
        out = F.regexp_replace(out, rf"([\x{{0904}}-\x{{0963}}]){stroke}", f"$1{sign}")
    return _where(text, "[|~^]", out)


def _whole_words(text: F.Column) -> F.Column:
    return _where(text, rf"[{HYPHENS}]\n", F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{M}}])[{HYPHENS}]\n *(?=\p{{L}})", ""))


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, clean, scanned): on how many pages not scanned, and scanned, each word is found; words cut at line ends count whole.

    Words of several parts with hyphens count as such besides. Combined before the shuffle; repeated pages count again.
    """
    text = _whole_words(_strokes_read(_plain("text")))
    scanned = (F.col("origin") == "scan").cast("int")
    whole = F.col("text")
    compounds = F.when(whole.contains("-"), F.regexp_extract_all(whole, F.lit(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    words = F.array_distinct(F.concat(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), compounds))
    each = pages.select(text.alias("text"), scanned.alias("scanned")).select(F.explode(words).alias("word"), "scanned")
    return each.groupBy("word").agg(F.sum(1 - F.col("scanned")).alias("clean"), F.sum("scanned").alias("scanned"))


def misread_words(vocab: DataFrame) -> DataFrame:
    """(word, meant): words of scanned pages that are a likely misreading of a word of the vocabulary, once each.

    A stem that clean pages have with another ending vouches for the word too, as do endings that are no ending but nearly one.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(f, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in misreadings(w) if len(w) >= 3]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in made], pa.string()),
                    pa.array([x[1] for x in made], pa.string()),
                    pa.array([x[2] for x in made], pa.int64()),
                ],
                names=["word", "meant", "pages"],
            )

    ending = "(?:" + "|".join(SUFFIXES) + ")$"
    stem = F.regexp_replace("word", ending, "")
    has_stem = (F.length(stem) >= 4) & (stem != F.col("word"))
    whole = vocab.select("word", "clean")
    stems = vocab.filter(has_stem & (F.col("clean") > 0)).groupBy(stem.alias("word")).agg(F.sum("clean").alias("clean")).select(
        F.concat("word", F.lit("+")).alias("word"),
        "clean",
    )
    known = whole.unionByName(stems)
    made = known.filter((F.col("clean") >= LEAST_PAGES) & F.col("word").rlike(r"\p{L}")).mapInArrow(forms, "word string, meant string, pages long")
    suspect = vocab.filter("scanned > 0")
    keys = F.array(F.col("word"), F.when(has_stem, F.concat(stem, F.lit("+"))))
    suspects = suspect.select(F.col("word").alias("read"), "clean", F.explode(F.array_compact(keys)).alias("word"))
    # what is as well known a stem itself is no misreading of another
    own = stems.select("word", F.col("clean").alias("own"))
    found = suspects.join(made, "word").filter(
        (F.col("clean") * RATIO <= F.col("pages")) & ((F.col("clean") == 0) | ~F.col("word").endswith("+"))
    ).join(own, "word", "left").filter(F.coalesce("own", F.lit(0)) * RATIO <= F.col("pages"))
    by_word = found.groupBy(F.col("read").alias("word")).agg(F.max(F.struct("pages", "meant")).alias("best")).select("word", F.col("best.meant").alias("meant"))
    wrong = F.coalesce(*[F.when(F.col("word").endswith(w), F.concat(F.expr(f"left(word, length(word) - {len(w)})"), F.lit(s))) for w, s in _WRONG_SUFFIX])
    by_ending = suspect.filter("clean = 0").select("word", wrong.alias("meant")).filter("meant IS NOT NULL AND length(word) >= 5")
    return by_word.unionByName(by_ending).groupBy("word").agg(F.min("meant").alias("meant"))


#: A line that ends inside a word or at a hyphen of its own, and the part of the word on the line behind.
CUT, GOES_ON = rf"[\p{{L}}\p{{M}}\x{{FFFD}}][{HYPHENS}]\s*$", r"^\s*[\p{L}\x{FFFD}]"
LEFT, RIGHT = rf"({WORD})[{HYPHENS}]\s*$", rf"^\s*({WORD})"


def scanned_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no, line, behind, cut, carried) of the scanned pages: whether a line ends at a hyphen, then with the line behind, and whether the one before does. Repeated pages are one."""
    text = F.split(_plain("text"), "\n", -1)
    each = pages.filter("origin = 'scan'").select("id", text.alias("lines"))
    each = each.select("id", F.posexplode("lines").alias("k", "line"), "lines").select(
        "id",
        (F.col("k") + 1).alias("line_no"),
        "line",
        F.get("lines", F.col("k") + 1).alias("behind"),
        F.get("lines", F.col("k") - 1).alias("ahead"),
    )
    ends = lambda a, b: F.coalesce(F.col(a).rlike(CUT) & F.col(b).rlike(GOES_ON), F.lit(False))
    each = each.select("id", "line_no", "line", "behind", ends("line", "behind").alias("cut"), ends("ahead", "line").alias("carried")).filter("line <> ''")
    return each.withColumn("behind", F.when(F.col("cut"), F.col("behind"))).distinct()


def cut_words(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, line_no): lines that end inside a word by a mark that is not the word's own.

    A hyphen is the word's own if the corpus has the two parts with a hyphen at least as often as as one word, or has
    neither but each part as a word by itself. Other marks than hyphens, such as soft ones, are no word's own.
    """
    cut = lines.filter("cut")
    left = F.regexp_extract("line", rf"([\p{{L}}\p{{M}}\p{{Nd}}�‌‍-]+)([{HYPHENS}])\s*$", 1)
    mark = F.regexp_extract("line", rf"([{HYPHENS}])\s*$", 1)
    right = F.regexp_extract("behind", r"^\s*([\p{L}\p{M}\p{Nd}�‌‍]+)", 1)
    cut = cut.select("id", "line_no", left.alias("left"), right.alias("right"), mark.isin("-", "‐", "‑").alias("plain"))
    # all spellings are looked up in one join
    spelled = {"own": F.concat("left", F.lit("-"), "right"), "joined": F.concat("left", "right"), "left": F.col("left"), "right": F.col("right")}
    each = cut.select("id", "line_no", "plain", F.explode(F.array(*[F.struct(F.lit(n).alias("as"), c.alias("word")) for n, c in spelled.items()])).alias("w"))
    counted = each.select("id", "line_no", "plain", "w.as", "w.word").join(vocab.select("word", "clean", "scanned"), "word", "left")
    n = lambda how, c: F.coalesce(F.max(F.when(F.col("as") == how, c)), F.lit(0))
    clean, scanned = F.col("clean"), F.col("scanned")
    # on the page itself the joined word is counted once
    known = counted.groupBy("id", "line_no").agg(
        F.max("plain").alias("plain"), n("own", clean + scanned).alias("n_own"), n("joined", clean).alias("n_joined"), n("joined", clean + scanned).alias("n_known"),
        F.least(n("left", clean), n("right", clean)).alias("n_parts"),
    )
    two_words = (F.col("n_joined") == 0) & (F.col("n_known") < 2) & (F.col("n_parts") >= LEAST_PAGES)
    own = F.when(F.col("n_own") > 0, F.col("n_joined") <= F.col("n_own")).otherwise(two_words)
    return known.filter(~(F.col("plain") & own)).select("id", "line_no")


def misread_lines(lines: DataFrame, misread: DataFrame) -> DataFrame:
    """(id, line_no, word, meant): lines with a word in which a character was read wrongly or lost. meant is null where nothing tells it.

    A word cut at the line end is looked up whole and counts for the line on which it departs from the word meant.
    """
    whole = F.when(F.col("cut"), F.regexp_replace("line", LEFT, "")).otherwise(F.col("line"))
    whole = F.when(F.col("carried"), F.regexp_replace(whole, RIGHT, "")).otherwise(whole)
    inside = F.transform(
        F.array_distinct(F.regexp_extract_all(_strokes_read(F.col("whole")), F.lit(WORD), F.lit(0))),
        lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("left")),
    )
    left = _strokes_read(F.regexp_extract("line", LEFT, 1))
    over = F.array(F.struct(F.concat(left, _strokes_read(F.regexp_extract("behind", RIGHT, 1))).alias("word"), F.length(left).alias("left")))
    words = lines.withColumn("whole", whole).select("id", "line_no", F.inline(F.when(F.col("cut"), F.concat(inside, over)).otherwise(inside)))
    spoilt = F.col("line").rlike(SPOILT_SIGN) & F.col("line").rlike(SPOILT)
    forms = misread.select(F.xxhash64("word").alias("h"), F.col("word").alias("form"), "meant")
    size = misread.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("meant") + 48), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        forms = F.broadcast(forms)
    same = F.expr("size(filter(sequence(1, length(meant)), i -> left(word, i) = left(meant, i)))")
    known = words.withColumn("h", F.xxhash64("word")).join(forms, "h").filter("word = form").select(
        "id",
        (F.col("line_no") + F.when(same >= F.col("left"), 1).otherwise(0)).alias("line_no"),
        "word",
        "meant",
    )
    return known.unionByName(
        lines.filter(spoilt).select("id", "line_no", F.lit("").alias("word"), F.lit(None).cast("string").alias("meant"))
    ).groupBy("id", "line_no", "word").agg(F.max("meant").alias("meant"))


_EDGE = " \t    .[]()|*~=_·•:—–-‒"
_FIGURES = re.compile(r"\b(?=\w*\d)[0-9०-९oOlISsB]+\b")
_NUMBER_FIRST = re.compile(r"^\W*?([0-9०-९oOlIS]{1,5})(?: {2,}|\t+| *[.·]{3,} *| +[–—|] +)(\S.*)$")
_NUMBER_LAST = re.compile(r"^\s*(\S.*?)(?: {2,}|\t+| *[.·]{3,} *| +[–—|] +)([0-9०-९oOlIS]{1,5})\W*$")


def number(token: str) -> int | None:
    """The number a token stands for; letters that are read for digits count as these if there is a digit as well."""
    if not token or not all(c in DIGITS for c in token) or not any(c.isdigit() for c in token):
        return None
    return int("".join(DIGITS[c] for c in token))


def _core(line: str) -> str:
    """What recurs of a line: in lower case, without adornment, its figures as one sign, since chapters are numbered too."""
    return _FIGURES.sub("#", re.sub(r"\s+", " ", line.strip(_EDGE)).lower())


@lru_cache(200_000)
def _alike(a: str, b: str) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= SAME_HEAD and m.quick_ratio() >= SAME_HEAD and m.ratio() >= SAME_HEAD


def _page_number(line: str, own: int | None) -> bool:
    core = line.strip(_EDGE)
    parts = core.split()
    adorned = core != line.strip()
    if len(parts) == 2 and any(parts[0].rstrip(".").lower() == w or len(w) > 3 and _alike(parts[0].lower(), w) for w in PAGE_WORDS):
        n = number(parts[1])
        return n is not None and (own is None or n == own)
    if len(parts) != 1:
        return False
    n = number(parts[0])
    if n is None:
        return False
    return n == own if own is not None else adorned or n < 1000


EDGE_LINES = "doc string, id string, line_no int, kind string, core string, number string, ends boolean"


def edge_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, id, line_no, kind, core, number, ends) of the lines at the edges of pages: page numbers and heads with one, which a page tells by itself, and, of null kind, those that are heads if they recur.

    The page's own number is the printed one, or else follows from the document's shift. A line that carries the
    own number set apart is a head; so is one that repeats the title, which is one more line of the document. number: the figures in the line. ends: it may end a paragraph.
    """
    for frame in frames:
        out = []
        for page in frame.itertuples():
            title = _core(page.title or "")
            own = int(
                page.page_num
            ) if page.page_num is not None and page.page_num == page.page_num else page.k + int(page.shift) if page.shift is not None and page.shift == page.shift else None
            edges = [(e["line_no"], e["line"]) for e in page.edges]
            for side in (edges[:2], edges[2:][::-1]):
                told = False
                for rank, (no, line) in enumerate(side):
                    if not no or rank and not told:
                        break
                    if _page_number(line, own):
                        out.append((page.doc, page.id, no, "page_number", None, None, None))
                        told = True
                        continue
                    m, text, n = _NUMBER_FIRST.match(line), "", None
                    if m:
                        n, text = number(m[1]), m[2]
                    if (not m or n is None or own is not None and n != own) and (m := _NUMBER_LAST.match(line)):
                        n, text = number(m[2]), m[1]
                    set_apart = bool(m) and n is not None and (own is None or n == own)
                    core = _core(text if set_apart else line)
                    titled = bool(title) and (_alike(core, title) or len(core) >= 6 and len(core) >= 0.5 * len(title) and _alike(core, title[: len(core)]))
                    if set_apart or titled:
                        out.append((page.doc, page.id, no, "header", core, None, None))
                        told = True
                    elif rank == 0:
                        # the tail of a paragraph can recur as well: a recurring line must be more than a word, and no end of a sentence
                        figures = " ".join(_FIGURES.findall(line)) if "#" in core else None
                        out.append((page.doc, page.id, no, None, core, figures, line.rstrip()[-1:] in "।!?॥…" or len(core.split()) < 2 and len(core) < 9))
        yield pd.DataFrame(out, columns=["doc", "id", "line_no", "kind", "core", "number", "ends"])


def _pairs(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and text and number of every pair of neighbouring characters; the n-th of the same pair in a text is another."""
    numbers: dict[tuple[str, int], int] = {}
    at, of = [], []
    for i, t in enumerate(texts):
        seen: Counter[str] = Counter()
        for x in zip(t, t[1:]):
            at.append(i)
            of.append(numbers.setdefault(("".join(x), seen["".join(x)]), len(numbers)))
            seen["".join(x)] += 1
    return np.array([len(t) for t in texts]), np.array(at, dtype=np.int64), np.array(of, dtype=np.int64)


def near_texts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of every two texts that may be alike, by the pairs of characters they share.

    Alike texts of a and b characters match in M >= SAME_HEAD / 2 * (a + b) of them, in at most a + b - 2 M + 1 blocks,
    and so share at least 3 M - (a + b) - 1 pairs: none that is alike is left out.
    """
    length, at, of = _pairs(texts)
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    first = np.searchsorted(of, of, "left")
    last = np.searchsorted(of, of, "right")
    by_text = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[by_text], np.arange(len(texts) + 1))
    count = last - first
    for i in range(len(texts) - 1):
        own = by_text[starts[i] : starts[i + 1]]
        # the places of all texts that have one of this text's pairs, range behind range
        ranges = np.arange(count[own].sum()) + np.repeat(first[own] - np.cumsum(count[own]) + count[own], count[own])
        shared = np.bincount(at[ranges], minlength=len(texts))
        both = length + length[i]
        may = (shared >= (1.5 * SAME_HEAD - 1) * both - 1 - 1e-6) & (np.abs(length - length[i]) <= 0.3 * np.maximum(length, length[i]))
        yield from ((i, int(j)) for j in np.flatnonzero(may[i + 1 :]) + i + 1)


def recurring(cores: list[str], head: list[bool], side: list[int] | None) -> tuple[set[int], set[int]]:
    """Which lines, heads left out, are like a head, and which like any line of some length; with sides, of the other side."""
    by_head: set[int] = set()
    again: set[int] = set()
    for i, j in near_texts(cores):
        if head[i] and head[j] or side and side[i] == side[j]:
            continue
        for a, b in ((i, j), (j, i)):
            if not head[a] and (head[b] and a not in by_head or len(cores[b]) >= 4 and a not in again) and _alike(cores[a], cores[b]):
                again |= {a} if len(cores[b]) >= 4 else set()
                by_head |= {a} if head[b] else set()
    return by_head, again


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, x, y, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cores = [r["core"] for r in rows]
            by_head, again = recurring(cores, [r["head"] for r in rows], [r["side"] for r in rows] if x != y else None)
            out += [(doc, cores[i], i in by_head, i in again) for i in sorted(by_head | again)]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc", "core", "by_head", "again"])


def heads_and_numbers(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, line_no, kind), kind header or page_number, of the scanned pages; distinct.

    Pages are judged where they are read; only the different lines at the edges are shuffled. A line is also a head if it resembles an edge line of another page of the document,
    however long that is: its different lines are compared in pairs of parts of LINES_AT_ONCE. titles (doc,
    title) are the documents' titles, if there are any.
    """
    lines = F.transform(F.split(F.translate(F.col("text"), INVISIBLE + "­", ""), "\n", -1), lambda line, k: F.struct((k + 1).alias("line_no"), line.alias("line")))
    shown = F.filter(lines, lambda x: x["line"].rlike(r"[^\s   ]"))
    k = F.coalesce(F.try_to_number(F.regexp_extract("id", r"#(\d{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    scanned = pages.filter("origin = 'scan'").select(F.regexp_extract("id", r"^([^#]*)", 1).alias("doc"), "id", "page_num", k.alias("k"), "text")
    none = F.struct(F.lit(0).alias("line_no"), F.lit("").alias("line"))
    # the first two and the last two, these no line twice
    size = F.size("shown")
    at = lambda i, ok: F.when(ok, F.struct(F.get("shown", i)["line_no"].alias("line_no"), F.regexp_replace(F.regexp_replace(F.get("shown", i)["line"], r" {4,}", "    "), r"\.{5,}", ".....").alias("line"))).otherwise(none)
    edges = F.array(at(F.lit(0), size > 0), at(F.lit(1), size > 1), at(size - 2, size > 3), at(size - 1, size > 2))
    near = scanned.withColumn("shown", shown).select("doc", "id", "page_num", "k", edges.alias("edges")).distinct()
    # the usual distance of printed and counted number, of each document as a whole
    shifts = scanned.filter("page_num IS NOT NULL").select(
        "doc",
        "id",
        (F.col("page_num") - F.col("k")).cast("long").alias("shift"),
    ).distinct().groupBy("doc", "shift").count()
    shifts = shifts.groupBy("doc").agg(F.max(F.struct("count", -F.abs("shift"), "shift"))["shift"].alias("shift"))
    near = near.join(shifts, "doc", "left")
    if titles is not None:
        near = near.join(titles.select("doc", "title").filter("title IS NOT NULL").groupBy("doc").agg(F.max("title").alias("title")), "doc", "left")
    else:
        near = near.withColumn("title", F.lit(None).cast("string"))
    told = materialise(near.mapInPandas(edge_lines, EDGE_LINES), "scan-edge-lines")
    each = told.filter("core IS NOT NULL").groupBy("doc", "core").agg(F.count("*").alias("n"), F.max(F.col("kind").isNotNull()).alias("head"))
    parts = each.groupBy("doc").agg(F.ceil(F.count("*") / LINES_AT_ONCE).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("core"), F.col("parts")).cast("int")
    paired = each.join(parts, "doc").withColumn("side", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("doc", F.least("side", "with").alias("x"), F.greatest("side", "with").alias("y"), "side", "core", "head")
    paired = paired.repartition(shuffle_partitions(pages.sparkSession), "doc", "x", "y")
    blocks = paired.groupBy("doc", "x", "y").agg(F.collect_list(F.struct("core", "head", "side")).alias("rows")).filter("size(rows) > 1")
    like = blocks.mapInArrow(
        _recurring,
        "doc string, core string, by_head boolean, again boolean",
    ).groupBy("doc", "core").agg(F.max("by_head").alias("by_head"), F.max("again").alias("again"))
    heads = each.join(like, ["doc", "core"], "left").select(
        "doc",
        "core",
        (F.col("head") | F.coalesce("by_head", F.lit(False))).alias("sure"),
        ((F.col("n") >= 2) | F.coalesce("again", F.lit(False))).alias("again"),
    )
    # words with a number that stand at the edges of several documents, with several numbers, name chapters
    named = told.filter("kind IS NULL AND number IS NOT NULL").filter(F.col("core").rlike(r"\p{L}") & (F.size(F.split("core", " ")) <= CHAPTER_WORDS))
    named = named.groupBy("core").agg(
        F.count_distinct("doc").alias("docs"),
        F.count_distinct("number").alias("numbers"),
    ).filter(f"docs >= {CHAPTER_DOCS} AND numbers >= {CHAPTER_DOCS}")
    maybe = told.filter("kind IS NULL").join(heads, ["doc", "core"]).join(named.select("core", F.lit(True).alias("named")), "core", "left")
    found = maybe.filter("sure OR named OR again AND NOT ends").select("id", "line_no", F.lit("header").alias("kind"))
    return told.filter("kind IS NOT NULL").select("id", "line_no", "kind").unionByName(found).distinct()


def scan_noise(raw: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, line_no, kind) of the noisy lines of the scanned pages, and (id, line_no, word, meant) of the misread words.

    raw needs id, text and meta (page_num, origin). Lines are counted from 1 between line feeds. Null or empty
    texts have no noise, repeated rows are one page; kinds are hyphen, header, page_number and misread.
    """
    pages = raw.filter("text IS NOT NULL AND id IS NOT NULL").select(
        "id",
        "text",
        F.col("meta.page_num").alias("page_num"),
        F.coalesce(F.col("meta.origin"), F.lit("")).alias("origin"),
    )
    vocab = materialise(vocabulary(pages), "scan-vocabulary")
    lines = materialise(scanned_lines(pages), "scan-lines")
    edges = materialise(heads_and_numbers(pages, titles), "scan-edges")
    misread = materialise(misread_words(vocab), "scan-misread")
    body = edges.select("id", "line_no")
    words = misread_lines(lines, misread).join(body, ["id", "line_no"], "left_anti")
    cuts = cut_words(lines, vocab).join(body, ["id", "line_no"], "left_anti").join(
        body.select("id", (F.col("line_no") - 1).alias("line_no")),
        ["id", "line_no"],
        "left_anti",
    )
    kinds = edges.unionByName(cuts.withColumn("kind", F.lit("hyphen"))).unionByName(words.select("id", "line_no").distinct().withColumn("kind", F.lit("misread")))
    return kinds, words


def joined_paragraphs(text: str, drop: set[int], cut: set[int], words: dict[int, dict[str, str]]) -> str:
    """The page as paragraphs of one line each: without the dropped lines, cut words joined, misread words as they were meant."""
    parts: list[str] = [""]
    glue = False
    for no, line in enumerate(text.split("\n"), 1):
        if no in drop:
            continue
        if not line.strip():
            if parts[-1]:
                parts.append("")
            glue = False
            continue
        for wrong, meant in sorted(words.get(no, {}).items()):
            if not meant:
                continue
            line = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", meant, line, flags=re.IGNORECASE)
        if no in words:
            for stroke, letter in STROKES:
                line = re.sub(stroke, letter, line)
        line = line.strip()
        parts[-1] += line.lstrip() if glue or not parts[-1] else " " + line
        # behind a hyphen of the word's own there is no space either
        glue = no in cut or bool(re.search(r"\w[-‐‑]$", line))
        if no in cut:
            parts[-1] = parts[-1].rstrip(HYPHENS + " ")
    return "\n\n".join(p for p in parts if p)


def repaired_pages(raw: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, text): every scanned page as continuous paragraphs."""
    kinds, words = scan_noise(raw, titles)
    pages = raw.filter("text IS NOT NULL AND id IS NOT NULL AND meta.origin = 'scan'").groupBy("id").agg(F.min("text").alias("text"))
    marks = kinds.groupBy("id").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks"))
    meant = words.withColumn("meant", F.when(~F.col("meant").endswith("+"), F.col("meant"))).groupBy("id").agg(
        F.collect_list(F.struct("line_no", "word", "meant")).alias("meant")
    )

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, marked, said in zip(b["text"], b["marks"], b["meant"], strict=True):
                marked = [] if marked is None else marked
                by_line: dict[int, dict[str, str]] = {}
                for x in [] if said is None else said:
                    by_line.setdefault(x["line_no"], {})[x["word"]] = x["meant"]
                texts.append(
                    joined_paragraphs(
                        t,
                        {m["line_no"] for m in marked if m["kind"] in ("header", "page_number")},
                        {m["line_no"] for m in marked if m["kind"] == "hyphen"},
                        by_line,
                    )
                )
            yield pd.DataFrame({"id": b["id"], "text": texts})

    return pages.join(marks, "id", "left").join(meant, "id", "left").mapInPandas(repair, "id string, text string")
