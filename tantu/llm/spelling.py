"""Problem 4: one consistent coding for text that looks the same, by SQL run inside each Arrow partition."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tantu.llm.encoding import is_garbled
from tantu.session import materialise

#: Rows that go through the SQL at once.
ROWS_AT_ONCE = 100_000
#: Texts in another form than the usual one that are sent to all tasks, up to so many bytes of them; beyond that they are shuffled.
MOST_SENT = 32_000_000

# Characters without a visible effect, spaces that look like the plain one, and letters that look alike.
INVISIBLE = "\\x{00AD}\\x{034F}\\x{061C}\\x{180E}\\x{200B}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FE00}-\\x{FE0F}\\x{FEFF}"
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
CYRILLIC, CYRILLIC_AS = "асеорхуіѕјһԁԛԝӏАВСЕНІЈКМОРЅТХУԌӀ", "aceopxyisjhdqwlABCEHIJKMOPSTXYGI"
GREEK, GREEK_AS = "αοιρυνγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoipuvyABEZHIKMNOPTYX"
#: Letters of other alphabets and phonetic ones that look like a Latin letter among Latin letters.
OTHER, OTHER_AS = "\u0261\u0251\u1d0f\u1d04\u1d20\u1d21\u1d22\u0131\u0585\u057d\u0578\u0570\u0581\u0575\u0566\u053c\u054f\u0555\u054d\u13aa\u13b3\u13d4\u13a5\u13bb\u13de\u13e6", "gaocvwziounhgjqLSOUGWTiHLK"
ARABIC, URDU = "يىكه", "ییکہ"
#: Devanagari, Thai and other sequences that are drawn like one character.
SEQUENCES = {
    "अा": "आ", "अॉ": "ऑ", "आॅ": "ऑ", "अॅ": "ॲ", "अो": "ओ", "आे": "ओ", "अौ": "औ", "आै": "औ", "एे": "ऐ", "एॅ": "ऍ",
    "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "।।": "॥", "เเ": "แ", "ํา": "ำ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "‐": "-", "‑": "-", "ऱ्": "र्\u200d",
}
#: Private characters that stand for a joiner to keep.
KEEP_ZWJ, KEEP_ZWNJ = "\ue0f0", "\ue0f1"
DUAL_JOINING = "بپتٹثجچحخسشصضطظعغفقکكگلمنںهہھیيىئ"


def _compatibility() -> tuple[str, str]:
    """Characters that look like one other character of which they are the compatibility form: full-width letters and
    digits, half-width kana, radicals, Arabic presentation forms, letters in another font. Raised, lowered and encircled ones look different."""
    blocks = ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B), (0xFF61, 0xFFA0), (0x2E80, 0x2FE0), (0xFB50, 0xFE00), (0xFE70, 0xFEFD))
    blocks += tuple((o, o + 1) for o in range(0x100, 0x20000) if unicodedata.decomposition(chr(o)).startswith(("<font>", "<compat>")) and chr(o).isalnum())
    pairs = {chr(o): n for a, b in blocks for o in range(a, b) if len(n := unicodedata.normalize("NFKC", chr(o))) == 1 and n != chr(o)}
    return "".join(pairs), "".join(pairs.values())


def _numerals() -> dict[str, str]:
    """Roman numerals that are one character, longest spelling first."""
    return {chr(o): n for o in range(0x2160, 0x2180) if len(n := unicodedata.normalize("NFKC", chr(o))) > 1}


def _wide_punctuation() -> tuple[str, str]:
    wide = [chr(o) for o in range(0xFF01, 0xFF5F) if not chr(o).isalnum()]
    return "".join(wide), "".join(chr(ord(c) - 0xFEE0) for c in wide)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def consistent_sql(column: str) -> str:
    """The SQL expression that brings a text to its usual form.

    Order: spaces, invisible characters, joiners (kept after a virama, where they change the cluster, and, a
    non-joiner, between letters that would join), compatibility forms, full-width punctuation in text
    without ideographs or kana, composition (NFC), sequences drawn like one character, Arabic letters in Urdu
    text, and look-alike letters inside words of another script. A whole word in a script of its own stays.
    """
    s = f"translate({column}, {_quoted(SPACES)}, {_quoted(' ' * len(SPACES))})"
    s = f"regexp_replace({s}, '[{INVISIBLE}]', '', 'g')"
    s = f"regexp_replace({s}, '(\u094d)\u200d', '\\1{KEEP_ZWJ}', 'g')"
    s = f"regexp_replace({s}, '(\u094d)\u200c([\\x{{0904}}-\\x{{0939}}\\x{{0958}}-\\x{{0961}}])', '\\1{KEEP_ZWNJ}\\2', 'g')"
    for _ in range(2):  # a letter between two joiners belongs to both matches
        s = f"regexp_replace({s}, '([{DUAL_JOINING}])\u200c([\\x{{0620}}-\\x{{06D3}}])', '\\1{KEEP_ZWNJ}\\2', 'g')"
    s = f"translate({s}, '{KEEP_ZWJ}{KEEP_ZWNJ}\u200d\u200c', '\u200d\u200c')"
    old, new = _compatibility()
    s = f"translate({s}, {_quoted(old)}, {_quoted(new)})"
    old, new = _wide_punctuation()
    s = f"(CASE WHEN regexp_matches({column}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]') THEN {s} ELSE translate({s}, {_quoted(old)}, {_quoted(new)}) END)"
    s = f"nfc_normalize({s})"
    for parts in (SEQUENCES, _numerals()):
        found, whole = "|".join(parts), s
        for old, new in parts.items():
            whole = f"replace({whole}, {_quoted(old)}, {_quoted(new)})"
        # hardly any text holds one of them
        s = f"list_transform([{s}], lambda u: CASE WHEN regexp_matches(u, '{found}') THEN {whole.replace(s, 'u')} ELSE u END)[1]"
    s = f"regexp_replace({s}, '\u0e4d([\u0e48-\u0e4b])\u0e32', '\\1\u0e33', 'g')"
    s = f"regexp_replace({s}, '([\\x{{0904}}-\\x{{0939}}\\x{{093E}}-\\x{{094C}}]):([\\x{{0904}}-\\x{{0939}}])', '\\1\u0903\\2', 'g')"
    s = f"regexp_replace({s}, '([\\x{{0904}}-\\x{{0963}}] ?)\\|', '\\1\u0964', 'g')"
    return f"(CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN {s} ELSE {column} END)"


def _words_sql(column: str) -> str:
    """Look-alike letters inside words, for text that has both kinds at all.

    A word all of whose letters look Latin is Latin, unless the word before or behind it is plainly of its own script.
    """
    like, latin = CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS
    own = "[\\p{Cyrillic}\\p{Greek}]"
    plainly = f"[^\\P{{Cyrillic}}{CYRILLIC}]|[^\\P{{Greek}}{GREEK}]"
    back = "".join(dict(zip(CYRILLIC_AS, CYRILLIC, strict=True)))
    beside = " OR ".join(f"coalesce(regexp_matches({x}, '{plainly}'), false)" for x in ("CASE WHEN i > 2 THEN ws[i - 2] END", "ws[i + 2]"))
    word = f"""CASE
      WHEN regexp_full_match(w, '[A-Za-z{OTHER}]+') AND regexp_matches(w, '[A-Za-z]') THEN translate(w, '{OTHER}', '{OTHER_AS}')
      WHEN NOT regexp_matches(w, '{own}') THEN w
      WHEN regexp_full_match(w, '[{like}]+') AND ({beside}) THEN w
      WHEN regexp_full_match(w, '[{like}]+') OR regexp_matches(w, '\\p{{Latin}}') AND NOT regexp_matches(w, '[^\\P{{Cyrillic}}{CYRILLIC}]') THEN translate(w, '{like}', '{latin}')
      WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, '{back}', '{CYRILLIC}')
      ELSE w END"""
    whole = f"list_transform([regexp_extract_all({column}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')], lambda ws: array_to_string(list_transform(ws, lambda w, i: {word}), ''))[1]"
    urdu = f"(CASE WHEN regexp_matches({column}, '[{ARABIC}]') AND regexp_matches({column}, '[ٹڈڑںےہھگپچی]') THEN translate({column}, '{ARABIC}', '{URDU}') ELSE {column} END)"
    mixed = f"regexp_matches({column}, '[\\p{{Cyrillic}}\\p{{Greek}}{OTHER}]') AND regexp_matches({column}, '[A-Za-z]')"
    return f"(CASE WHEN {mixed} OR regexp_full_match({column}, '[{like}]+') THEN {whole} ELSE {urdu} END)"


NORMAL = f"SELECT t, {_words_sql('s')} AS form FROM (SELECT t, {consistent_sql('t')} AS s FROM (SELECT DISTINCT t FROM rows WHERE t IS NOT NULL))"


def _through_sql(sql: str, after: Callable[[pa.Table], pa.Table] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Run the SQL over the batches of a partition, some at a time, each time as the table ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB"})
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            db.register("rows", pa.Table.from_batches(held))
            out = db.sql(sql).to_arrow_table()
            db.unregister("rows")
            yield from (after(out) if after else out).to_batches()

        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS_AT_ONCE or sum(x.nbytes for x in held) > 64e6:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def consistent(rows: DataFrame, column: str) -> DataFrame:
    """rows with the text of ``column`` in its usual form. Nulls and empty texts stay; other columns are untouched."""
    schema = rows.schema
    names = ", ".join("n.form AS t" if f.name == column else f'r."{f.name}"' for f in schema)
    sql = f"SELECT {names} FROM rows r LEFT JOIN ({NORMAL}) n ON r.t = n.t".replace("r.t = n.t", f'r."{column}" = n.t').replace(
        "DISTINCT t FROM rows WHERE t IS",
        f'DISTINCT "{column}" AS t FROM rows WHERE "{column}" IS',
    ).replace("n.form AS t", f'n.form AS "{column}"')
    return rows.mapInArrow(_through_sql(sql), schema)


ODD = f"SELECT t FROM ({NORMAL}) WHERE form <> t"


def inconsistent(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(rec_key) of the rows whose text changes when it is brought to its usual form; distinct.

    key is an SQL expression over rows for the record's key. For short texts that recur often: each different one is judged once, and
    those found are joined back. A null text or key is no record.
    """
    texts = rows.select(F.expr(key).alias("rec_key"), F.col(column).alias("t")).filter("rec_key IS NOT NULL AND t IS NOT NULL")
    odd = materialise(texts.select("t").distinct().mapInArrow(_through_sql(ODD), "t string"), "odd-texts")
    size = odd.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    return texts.join(F.broadcast(odd) if size <= MOST_SENT else odd, "t", "left_semi").select("rec_key").distinct()


def inconsistent_pages(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(rec_key) as inconsistent has it, for long texts, which are judged where they are read; texts that were decoded in the wrong encoding are left out."""
    sql = f"SELECT r.k AS rec_key, r.t AS t FROM rows r JOIN ({ODD}) n ON r.t = n.t WHERE r.k IS NOT NULL"

    def after(out: pa.Table) -> pa.Table:
        out = out.filter(pa.array([not is_garbled(t, scan=False) for t in out["t"].to_pylist()], pa.bool_()))
        return out.select(["rec_key"]).cast(pa.schema([("rec_key", pa.string())]))

    return rows.select(F.expr(key).alias("k"), F.col(column).alias("t")).mapInArrow(_through_sql(sql, after), "rec_key string").distinct()
