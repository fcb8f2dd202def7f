"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a text's most frequent letter n-grams (1 to 3 letters, word ends marked) in order of
frequency. A document's distance to a language is the sum over its profile of how far each n-gram is out of place in
the language's profile, at most PROFILE for one that is not there. The nearest language is predicted.

Profiles are learned from at most MAX_DOCS labelled documents a language (a documented bound: by a hash of the id, all
of them where there are fewer) and of MAX_LANGS languages; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import crc_mod, release, unused

PROFILE = 300
#: Least score of a document that keep_identified() keeps; prose scores 0.55 and more, single words 0.4.
MIN_SCORE = 0.3
#: Expected number of documents of a language that its profile is learned from, where there are more; most languages that are
#: learned (of more labels, those with the most documents), so that profiles fit in memory.
MAX_DOCS, MAX_LANGS = 4000, 1000
EDGE = 0x1FFFFF
_fold: np.ndarray | None = None


def _table() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, 0 for others."""
    global _fold
    if _fold is None:
        table = np.zeros(0x10000, dtype=np.uint64)
        for c in range(0x10000):
            if 0xD800 <= c < 0xE000 or not (ch := chr(c)).isalpha():
                continue
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def letters(text: str | None) -> np.ndarray:
    """Letters of a text as code points, EDGE at both ends and for each run of others; only EDGE if it has none."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    high = cps > 0xFFFF
    out = _table()[np.where(high, 0, cps)]
    if high.any():
        rare = {int(c): ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 0 for c in np.unique(cps[high])}
        out[high] = [rare[int(c)] for c in cps[high]]
    out = np.concatenate(([0], out, [0])).astype(np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    out = out[keep]
    out[out == 0] = EDGE
    return out


def gram_codes(x: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of letters(): 1 letter, 2 and 3 symbols; no 3-gram goes over a word's end."""
    edge = np.uint64(EDGE)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    return np.concatenate((x[x != edge], two, three[x[1:-1] != edge]))


def ranked(codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` most frequent codes and their counts, ties in order of code."""
    s = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.diff(np.append(at, len(s)))
    order = np.argsort(-n, kind="stable")[:top]
    return s[at[order]], n[order]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram counts by language, a few thousand documents at a time."""
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            kept: list[np.ndarray] = []
            size = 0
            for t in texts:
                x = letters(t)
                if len(x) > 1:
                    kept.append(gram_codes(x))
                    size += len(kept[-1])
                if size > 2_000_000:
                    yield _counts(lang, kept)
                    kept, size = [], 0
            if kept:
                yield _counts(lang, kept)
        release()


def _counts(lang: str, kept: list[np.ndarray]) -> pd.DataFrame:
    codes, n = np.unique(np.concatenate(kept), return_counts=True)
    return pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n.astype(np.int64)})


class Profiles:
    """Ranks of the languages' n-grams: codes sorted, one column of ranks a language, 2 * PROFILE where it lacks one, which is
    out of place by more than counts wherever it stands."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        self.codes = np.unique(np.array([c for v in ranks.values() for c in v], dtype=np.uint64))
        self.ranks = np.full((len(self.codes), len(self.langs)), 2 * PROFILE, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(ranks[lang], dtype=np.uint64)), k] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = letters(text)
        if len(x) < 2 or not self.langs:
            return "und", 0.0
        own, _ = ranked(gram_codes(x), PROFILE)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        there = self.codes[at] == own
        far = np.abs(self.ranks[at[there]] - np.flatnonzero(there)[:, None])
        out = np.minimum(far, PROFILE).sum(0) + PROFILE * int((~there).sum())
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (PROFILE * len(own))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> Profiles:
    """Profiles from the labelled training rows: id's crc32 mod 5 not 0 (so an id is needed), text and lang not null.

    Only the max_langs labels with the most rows are learned (ties by name): their shares are broadcast, and PROFILE ranks of
    each come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((crc_mod("id", 5) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang", F.least(F.lit(1.0), max_docs / F.col("n")).alias("share"))
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("u", u).join(F.broadcast(shares), "lang").where("u < share")
    counts = chosen.select("lang", "text").mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= PROFILE)
    ranks: dict[str, dict[int, int]] = {}
    for r in top.select("lang", "code", "r").collect():  # PROFILE rows each of at most max_langs
        ranks.setdefault(r.lang, {})[r.r] = r.code
    return Profiles({k: [v[i] for i in sorted(v)] for k, v in ranks.items()})


def predicted(docs: DataFrame, profiles: Profiles, text_col: str = "text", name: str = "_lang") -> DataFrame:
    """docs with one more column, struct<lang_pred string, score double>."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])
        release()
        return out

    return docs.withColumn(name, predict(F.col(text_col).cast("string")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (1 less the mean distance as a share of the largest).

    `und` with score 0 for texts that are null or have no letter, and for all where no language could be learned. A
    null id is not held out and not learned from. Rows that repeat are predicted alike; equally near languages go by name; other
    columns are ignored. An empty table gives an empty result.
    """
    profiles = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predicted(rows, profiles).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "_lang.lang_pred", "_lang.score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows whose language cannot be told: no letters (a null text among them), or a score below min_score.

    All columns of docs, whatever their names; repeated rows stay or go together, and an empty table stays empty.
    """
    (lang,) = unused(docs, "_skein_lang")
    found = predicted(docs, learn(docs), name=lang)
    return found.where((F.col(f"{lang}.lang_pred") != "und") & (F.col(f"{lang}.score") >= min_score)).drop(lang)
