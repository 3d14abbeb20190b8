"""Problem 10: cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a character beyond its first, at most.
CHAR_TAIL = 3


def _utf8(chars: str) -> str:
    """The characters as an alternation of byte sequences, one regex character a byte."""
    return "|".join("".join(f"\\x{b:02X}" for b in c.encode()) for c in chars)


#: Sentence terminators that a space follows, and those that stand without one.
SPACED, UNSPACED = _utf8(".!?।॥۔؟…"), _utf8("。！？｡")
CLOSING = _utf8("\"')]}”’»）」』")


def boundary_pattern(most: int) -> str:
    """A piece of up to ``most`` bytes, one regex character a byte: the rest of the text, else up to the last paragraph end,
    sentence end or word end in the second half, else up to the last whole character."""
    half = max(1, most // 2)
    upto = f".{{{half},{most}}}"
    return "(?s)" + "|".join([
        f".{{1,{most}}}+\\z",
        f"{upto}(?<=\\n[ \\t\\r]{{0,8}}\\n)",
        f"{upto}(?<=(?:{SPACED})(?:{CLOSING})?(?:{CLOSING})?\\s)",
        f"{upto}(?<=(?:{UNSPACED})(?:{CLOSING})?(?:{CLOSING})?)(?!{CLOSING})",
        f"{upto}(?<=\\s)",
        f".{{1,{most}}}(?![\\x80-\\xBF])",
    ])


#: Piece lengths that are summed up in one go; the sums of these groups follow.
GROUP = 256


def _aligned(raw: Column, at: Column) -> Column:
    """The byte offset, or up to three before it, at which a character starts."""
    inside = lambda k: F.hex(F.substring(raw, at - k + 1, 1)).between("80", "BF")
    return at - F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(CHAR_TAIL)


def _running(values: Column) -> Column:
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
    return F.aggregate(values, F.array().cast("array<int>"), lambda done, n: F.concat(done, F.array(last(done) + n)))


def _ends(cuts: Column) -> Column:
    """Running sums of an array that is not empty, group by group, so that a text of many pieces takes no longer for each."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / GROUP).cast("int")), lambda g: _running(F.slice(cuts, g * GROUP + 1, F.lit(GROUP))))
    return F.transform(groups, lambda g: F.struct(g.alias("ends"), F.element_at(g, -1).alias("total")))


def split_texts(docs: DataFrame, limit: int, overlap: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no, n_pieces, start, n_tokens, piece): texts in pieces of at most ``limit`` tokens, a token being one UTF-8 byte.

    A text within the limit is its only piece. Of a larger one every piece but the first repeats the last
    ``overlap`` tokens of the one before, or up to three more where these would begin inside a character.
    start counts bytes from 0. A null text gives no piece, an empty one an empty piece. Rows are neither
    shuffled nor compared, so repeated rows give repeated pieces.
    """
    most = limit - overlap - CHAR_TAIL
    if most < 2 * (CHAR_TAIL + 1) or overlap < 0:
        raise ValueError("the limit must exceed the overlap by more than 10 tokens")
    raw = F.encode(F.col(text), "UTF-8")
    one_a_byte = F.decode(F.col("__raw"), "ISO-8859-1")
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key), raw.alias("__raw")).withColumn("__size", F.length("__raw"))
    cuts = F.when(
        F.col("__size") > limit,
        F.transform(F.regexp_extract_all(one_a_byte, F.lit(boundary_pattern(most)), F.lit(0)), F.length),
    ).otherwise(F.array(F.col("__size")))
    rows = rows.withColumn("__cuts", cuts).withColumn("__groups", _ends(F.col("__cuts")))
    rows = rows.withColumn("__before", F.concat(F.array(F.lit(0)), _running(F.transform("__groups", lambda g: g["total"]))))
    ends = F.flatten(F.transform("__groups", lambda g, i: F.transform(g["ends"], lambda e: e + F.get("__before", i))))
    spans = F.zip_with(
        "__cuts",
        ends,
        lambda n, stop: F.struct(
            F.when(stop == n, F.lit(0)).otherwise(_aligned(F.col("__raw"), stop - n - overlap)).alias("start"),
            stop.alias("stop"),
        ),
    )
    rows = rows.withColumn("__spans", spans)
    # the pieces are cut before the rows are made, so that no row carries the whole text
    pieces = F.transform(
        "__spans",
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["stop"] - x["start"]).alias("n_tokens"),
            F.decode(F.substring(F.col("__raw"), x["start"] + 1, x["stop"] - x["start"]), "UTF-8").alias("piece"),
        ),
    )
    out = rows.select(key, F.size("__cuts").alias("n_pieces"), F.posexplode(pieces).alias("piece_no", "__piece"))
    return out.select(key, "piece_no", "n_pieces", "__piece.start", "__piece.n_tokens", "__piece.piece")
