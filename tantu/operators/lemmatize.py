"""Lemmatizers as plug-ins: distinct tokens are analysed once, in batches, and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tantu.functions.script import DEVANAGARI, Profile, is_weird
from tantu.operators.joins import spread_join
from tantu.operators.tokens import exploded

ANALYSIS = "lemma string, pos string, analyses array<string>, is_oov boolean, is_ambiguous boolean, status string, error string"
BATCH = 50


@dataclass
class Analysis:
    """readings: (lemma, tags) in order of preference; none means an unknown token."""

    readings: list[tuple[str, list[str]]] = field(default_factory=list)


class Lemmatizer(Protocol):
    def open(self) -> None:
        """Load the model, once a task."""

    def analyse(self, tokens: list[str]) -> Iterable[Analysis]:
        """One analysis for each token, in order."""


@dataclass
class SuffixLemmatizer:
    """Strips the longest of its suffixes that leaves at least ``least`` characters; known words (lemma by form) come first."""

    suffixes: tuple[str, ...] = ()
    known: dict[str, str] = field(default_factory=dict)
    least: int = 2

    def open(self) -> None:
        self._by_length = sorted(self.suffixes, key=len, reverse=True)

    def analyse(self, tokens: list[str]) -> Iterable[Analysis]:
        for t in tokens:
            out = [(self.known[t], ["known"])] if t in self.known else []
            out += [(t[: -len(s)], ["stem", s]) for s in self._by_length if t.endswith(s) and len(t) - len(s) >= self.least][:1]
            yield Analysis(out)


#: Case and postposition endings, a fixed list, for use without a model.
MARATHI_SUFFIXES = ("पासून", "मध्ये", "साठी", "च्या", "तून", "कडे", "वर", "ला", "ने", "चा", "ची", "चे", "त")


def analysed(token: str, analysis: Analysis) -> dict:
    """Row of one token: the first reading's lemma without unknown marker, its first tag, all readings, unknown and ambiguous marks."""
    readings = [(lemma.removeprefix("*"), tags) for lemma, tags in analysis.readings]
    unknown = not token or not readings or analysis.readings[0][0].startswith("*")
    names = {lemma for lemma, _ in readings if lemma}
    return {
        "lemma": token if not readings else readings[0][0] or token, "pos": readings[0][1][0] if readings and readings[0][1] else None,
        "analyses": [lemma + "".join(f"<{t}>" for t in tags) for lemma, tags in readings], "is_oov": unknown, "is_ambiguous": len(names) > 1, "status": "ok", "error": None,
    }


def analyse_distinct(tokens: DataFrame, lemmatizer: Lemmatizer, *, batch: int = BATCH) -> DataFrame:
    """(token, lemma, pos, analyses, is_oov, is_ambiguous, status, error) of every distinct token.

    A batch that fails is tried token by token; a token that fails is a row of status error. A lemmatizer that cannot be opened
    fails the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lemmatizer.open()
        for frame in frames:
            out = []
            words = frame["token"].tolist()
            for at in range(0, len(words), batch):
                part = words[at : at + batch]
                try:
                    got = list(lemmatizer.analyse(part))
                    if len(got) != len(part):
                        raise ValueError("as many analyses as tokens were expected")
                    out += [analysed(t, a) for t, a in zip(part, got, strict=True)]
                except Exception:  # noqa: BLE001
                    for t in part:
                        try:
                            out.append(analysed(t, next(iter(lemmatizer.analyse([t])))))
                        except Exception as e:  # noqa: BLE001
                            out.append(
                                {
                                    "lemma": t,
                                    "pos": None,
                                    "analyses": [],
                                    "is_oov": True,
                                    "is_ambiguous": False,
                                    "status": "error",
                                    "error": f"{type(e).__name__}: {e}"[:500],
                                }
                            )
            yield pd.concat(
                [
                    frame[["token"]].reset_index(drop=True),
                    pd.DataFrame(out, columns=["lemma", "pos", "analyses", "is_oov", "is_ambiguous", "status", "error"]),
                ],
                axis=1,
            )

    return tokens.select("token").filter(F.col("token").isNotNull()).distinct().mapInPandas(run, f"token string, {ANALYSIS}")


def lemmatize(tokens: DataFrame, lemmatizer: Lemmatizer, *, drop_weird: bool = True, script: Profile = DEVANAGARI) -> DataFrame:
    """tokens (doc_id, sent_no, tok_no, token) with their analyses. Weird tokens are dropped if wanted; sentences left empty still count in a sentence table."""
    if drop_weird:
        tokens = tokens.filter(~is_weird(F.col("token"), script))
    most = tokens.groupBy("token").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return spread_join(tokens, analyse_distinct(tokens, lemmatizer), "token", most)


def lemmatize_documents(docs: DataFrame, lemmatizer: Lemmatizer, *, drop_weird: bool = True, script: Profile = DEVANAGARI) -> DataFrame:
    """(id, lang, sentences, meta) of tokenized documents: sentences of (token, lemma, pos, analyses, is_oov, is_ambiguous). A sentence left without a token stays, empty."""
    words = lemmatize(exploded(docs), lemmatizer, drop_weird=drop_weird, script=script)
    row = F.struct("tok_no", F.struct("token", "lemma", "pos", "analyses", "is_oov", "is_ambiguous").alias("w"))
    kept = words.groupBy("doc_id", "sent_no").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["w"]).alias("words"))
    places = docs.select(F.col("id").alias("doc_id"), F.posexplode("sentences").alias("sent_no", "__s")).select("doc_id", "sent_no").distinct()
    filled = places.join(kept, ["doc_id", "sent_no"], "left").withColumn("words", F.coalesce("words", F.array().cast(kept.schema["words"].dataType)))
    whole = filled.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "words"))), lambda x: x["words"]).alias("sentences"))
    heads = docs.select(F.col("id").alias("doc_id"), "lang", "meta").dropDuplicates(["doc_id"])
    return heads.join(whole, "doc_id").select(F.col("doc_id").alias("id"), "lang", "sentences", "meta")


def label_names(words: DataFrame, labels: DataFrame) -> DataFrame:
    """words (doc_id, sent_no, tok_no, ...) with the label of the same place: is_ne and ner_result; without one, Other and no name."""
    clean = labels.select("doc_id", "sent_no", "tok_no", F.element_at(F.split("label", "-"), -1).alias("ner_result"))
    out = words.join(clean, ["doc_id", "sent_no", "tok_no"], "left")
    out = out.withColumn("ner_result", F.coalesce("ner_result", F.lit("Other")))
    return out.withColumn("is_ne", ~F.col("ner_result").isin("Other", "O"))


def packed_sentences(sizes: list[int], most: int = 80) -> list[list[int]]:
    """Consecutive sentences in groups of at most ``most`` tokens; a longer sentence is a group of its own."""
    out: list[list[int]] = []
    total = most + 1
    for i, n in enumerate(sizes):
        if total + n > most:
            out.append([])
            total = 0
        out[-1].append(i)
        total += n
    return out


def chunks(docs: DataFrame, most: int = 80) -> DataFrame:
    """(id, sent_no, chunk): the sentences of each document in chunks of consecutive ones of at most ``most`` tokens, as models take them."""
    sizes = docs.filter("sentences IS NOT NULL").select("id", F.transform("sentences", lambda s: F.coalesce(F.size(s), F.lit(0))).alias("sizes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, k, n) for i, own in zip(frame["id"], frame["sizes"], strict=True) for n, group in enumerate(packed_sentences(list(own), most)) for k in group]
            yield pd.DataFrame(out, columns=["id", "sent_no", "chunk"])

    return sizes.mapInPandas(run, "id string, sent_no int, chunk int")


def first_labels(parts: DataFrame) -> DataFrame:
    """(doc_id, sent_no, tok_no, label): the label of the first part of every word, from rows of parts of words (with part_no)."""
    return parts.groupBy("doc_id", "sent_no", "tok_no").agg(F.min(F.struct("part_no", "label"))["label"].alias("label"))


def page_texts(files: DataFrame, read: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(doc, page_num, text, error) of binary files (path, content), by a reader of pages; a file that fails is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            for content in frame["content"]:
                doc, rows = hashlib.sha256(content).hexdigest(), []
                try:
                    rows = [(doc, n, t, None) for n, t in enumerate(read(content), 1)]
                except Exception as e:  # noqa: BLE001
                    rows = [(doc, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=["doc", "page_num", "text", "error"])

    return files.select("content").mapInPandas(run, "doc string, page_num int, text string, error string")
