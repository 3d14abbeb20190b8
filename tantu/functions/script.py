"""Whether a token is a well-formed word of its script: class, validity, signs of bad recognition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Profile:
    """What is particular to a script. letters, digits: contents of character classes; virama: the sign that joins consonants."""

    name: str
    letters: str
    digits: str
    plain: str
    virama: str | None = None
    vowels: str | None = None


#: Fixed values.
DEVANAGARI = Profile("devanagari", r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", r"\x{0966}-\x{096F}0-9", r"\x{0900}-\x{097F}", "्", "अआइईउऊऋऌएऐओऔॠॡ")
LATIN = Profile("latin", r"A-Za-z\x{00C0}-\x{024F}", "0-9", r"A-Za-z\x{00C0}-\x{024F}")
LONGEST, VIRAMA_SHARE = 30, 0.35


def is_valid(token: Column, script: Profile = DEVANAGARI) -> Column:
    """Non-empty, of the script's characters only, not beginning with a mark."""
    return token.rlike(f"^[{script.letters}]+$") & ~token.rlike(r"^[\p{Mn}\p{Mc}]")


def is_garbage(token: Column, script: Profile = DEVANAGARI) -> Column:
    """Signs of bad recognition: too long, impossible clusters, too many viramas, a chunk of 2 to 4 characters three times running."""
    bad = (F.length(token) > LONGEST) | token.rlike(r"(.{2,4})\1\1")
    if script.virama:
        count = F.length(token) - F.length(F.replace(token, F.lit(script.virama), F.lit("")))
        share = F.try_divide(count.cast("double"), F.length(token))
        bad = bad | token.rlike(f"{script.virama}[{script.vowels}]") | token.contains(script.virama * 2) | (
            (F.length(token) > 3) & F.coalesce(share > VIRAMA_SHARE, F.lit(False))
        )
    return bad


def classify(token: Column, script: Profile = DEVANAGARI) -> Column:
    """non_<script>, invalid_<script's first four letters>, ocr_garbage or ok, tested in this order; empty and null tokens are of no script."""
    foreign = token.isNull() | ~F.coalesce(token.rlike(f"^[{script.letters}]+$"), F.lit(False))
    return (
        F.when(foreign, f"non_{script.name}")
        .when(~is_valid(token, script), f"invalid_{script.name[:4]}")
        .when(is_garbage(token, script), "ocr_garbage")
        .otherwise("ok")
    )


def is_weird(token: Column, script: Profile = DEVANAGARI) -> Column:
    """Neither all figures nor all of the script's main block."""
    return ~F.coalesce(token.rlike(f"^[{script.digits}]+$") | token.rlike(f"^[{script.plain}]+$"), F.lit(False))
