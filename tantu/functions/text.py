"""Text expressions: normalising, splitting, tokenising, cleaning, ids. All run inside the JVM but for Unicode composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, spelled out, since Java's \s knows ASCII only: a fixed value.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}_]"
#: Devanagari cleaning, fixed values: kept punctuation, digits and their ASCII forms.
KEPT = r"\x{0964}'\x{2013}\x{2014}\x{2026}\x{AB}\x{BB}"
ASCII_PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{|}~"""
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{AD}\\x{FEFF}]"
#: Letters NFC changes in text that is Devanagari only: (old, new).
DECOMPOSED = {chr(o): unicodedata.normalize("NFC", chr(o)) for o in range(0x958, 0x960)}
COMPOSED = {"ऩ": "ऩ", "ऱ": "ऱ", "ऴ": "ऴ"}


@F.pandas_udf(StringType())
def compose(s: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normalisation of any text to the form named."""
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(s, form, strict=True)])


def nfc(c: Column) -> Column:
    return compose(c, F.lit("NFC"))


def nfkc(c: Column) -> Column:
    return compose(c, F.lit("NFKC"))


def nfc_devanagari(c: Column) -> Column:
    """NFC of Devanagari in the JVM: marks put in their order (nukta, virama, accent below, accent above), then the letters that change."""
    c = F.regexp_replace(c, "([\\x{094D}\\x{0951}\\x{0952}]+)\\x{093C}", "\u093c$1")
    c = F.regexp_replace(c, "([\\x{0951}\\x{0952}]+)\\x{094D}", "\u094d$1")
    c = F.regexp_replace(c, "(\\x{0951}+)\\x{0952}", "\u0952$1")
    for old, new in (DECOMPOSED | COMPOSED).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def collapse_space(c: Column) -> Column:
    c = F.regexp_replace(c, SPACE + "+", " ")
    return F.regexp_replace(c, "^ | $", "")


def normalize_text(c: Column, *, strip_html: bool = True, compatibility: bool = True, lower: bool = False) -> Column:
    """Tags to spaces, NFKC, lower case, white space collapsed. Null stays null."""
    if strip_html:
        c = F.regexp_replace(c, "<[^>]+>", " ")
    if compatibility:
        c = nfkc(c)
    return collapse_space(F.lower(c) if lower else c)


def sentences(c: Column, terminators: str = ".!?") -> Column:
    """Sentences: cut behind a terminator that white space follows; trimmed, empty ones left out."""
    parts = F.split(c, rf"(?<=[{terminators}]){SPACE}+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


def words(c: Column) -> Column:
    """Tokens between white space, without leading and trailing characters that are no letters, figures or underscores."""
    trimmed = F.transform(F.split(c, SPACE + "+"), lambda t: F.regexp_replace(t, f"^{NON_WORD}+|{NON_WORD}+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def tokenize(c: Column, terminators: str = ".!?") -> Column:
    """array<array<string>>: the tokens of every sentence; sentences without a token are left out."""
    return F.filter(F.transform(sentences(c, terminators), words), lambda s: F.size(s) > 0)


def tokenize_padded(c: Column) -> Column:
    """Tokens of a sentence in which punctuation marks are tokens of their own."""
    return F.filter(F.split(F.regexp_replace(c, r"([\p{P}\p{S}])", " $1 "), SPACE + "+"), lambda t: t != "")


def clean_devanagari(c: Column, *, any_text: bool = True) -> Column:
    """Reduce text to Devanagari, ASCII figures and punctuation.

    In this order: NFC, non-breaking space, line feed, URLs, Devanagari figures to ASCII ones, foreign characters
    to spaces, runs of stops to their last, white space. any_text=False spares the composition outside the JVM.
    """
    c = nfc(c) if any_text else nfc_devanagari(c)
    c = F.translate(c, " \n", "  ")
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", " ")
    c = F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)
    c = F.regexp_replace(c, rf"[^\x{{0900}}-\x{{097F}}0-9{ASCII_PUNCTUATION}{KEPT}\x{{09}}-\x{{0D}} ]", " ")
    c = F.regexp_replace(c, r"([?!.,\x{0964}]){2,}", "$1")
    return collapse_space(c)


def normalize_devanagari(c: Column, *, any_text: bool = True) -> Column:
    """NFC without joiners and other invisible characters."""
    return F.regexp_replace(nfc(c) if any_text else nfc_devanagari(c), INVISIBLE, "")


def strip_marker(c: Column, markers: str = "*") -> Column:
    """Without the markers an analyser puts before unknown words."""
    return F.regexp_replace(c, "^[" + "".join("\\" + m for m in markers) + "]+" if len(markers) > 1 else "^\\" + markers, "")


def stripped_distinct(c: Column, markers: str = "*@#") -> Column:
    """An array of lemmas without markers, each once, in order of their first places."""
    return F.array_distinct(F.transform(c, lambda x: strip_marker(x, markers)))


def is_unknown(c: Column, markers: str = "*@#") -> Column:
    """Whether an analyser marks the lemma as unknown."""
    return F.substring(c, 1, 1).isin(*markers)


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def reading(lemmas: Column, tags: Column) -> Column:
    """lemma<tag><tag>+lemma<tag>: an analyser's reading as one string, from an array of lemmas and one of tag arrays."""
    pairs = F.arrays_zip(lemmas.alias("l"), tags.alias("t"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["l"], F.array_join(F.transform(p["t"], lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))), "+")


def label_class(c: Column) -> Column:
    """A sequence label without its position prefix: what stands behind the last hyphen."""
    return F.element_at(F.split(c, "-"), -1)


def shard(c: Column, suffix: str = "") -> Column:
    """Relative path of a record: folder of its first two characters, filled up with zeros on the left."""
    return F.concat(F.lpad(F.substring(c, 1, 2), 2, "0"), F.lit("/"), c, F.lit(suffix))


def fragment_id(build: Column, doc: Column, position: Column, ids: Column) -> Column:
    """Content hash of a fragment: sha-256 of build:doc:position:[id, id]."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: i.cast("string")), ", "), F.lit("]"))
    return F.sha2(F.concat_ws(":", build.cast("string"), doc.cast("string"), position.cast("string"), listed), 256)


def page_id(doc: Column, page: Column) -> Column:
    return F.concat(doc, F.lit("#"), page.cast("string"))


def relative_path(c: Column) -> Column:
    """Forward slashes, no leading one; null where the path would leave its root."""
    p = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when(~F.exists(F.split(p, "/"), lambda x: x == ".."), p)
