"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded texts.

Folding lowers letters and maps homoglyphs and digit substitutions to the letters they stand for.
Words with accents are matched as they are and without accents, as either may be what is meant. The lexicon is learned from labelled documents: words and stems that toxic documents
use far more often than others, weighted by their log odds. Phrases in which a lexicon word is
harmless, seen in several clean documents, are exceptions. A logistic scale turns the weighted
hits, as such and by length, into a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import bounded_batches, crc_mod, ids_and_texts

SAMPLE_DOCS = 8_000  #: labelled documents that the lexicon is learned from, at most
STEMS = (3, 4, 5, 6, 7, 8)  #: lengths of word beginnings tried as entries
MOST_ENTRIES = 400

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "һ": "h", "ӏ": "l", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


LATIN = range(0xC0, 0x250)  #: letters whose accents are kept at first


def _folding() -> tuple[dict[int, str | None], dict[int, str]]:
    """By a rule: letters of the compatibility decomposition, accents of Latin letters kept; and what takes those off. What is no letter is a space."""
    table: dict[int, str | None] = {}
    plain: dict[int, str] = {}
    for code in [*range(0x2C00), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Cf"):
            table[code] = None  # accents on other letters and zero-width characters go
            continue
        out = ""
        for c in unicodedata.normalize("NFKD", char.lower()):
            c = HOMOGLYPHS.get(c.lower(), SUBSTITUTES.get(c, c.lower()))
            out += c if c.isalnum() else ""
        if code in LATIN and char.isalpha():
            table[code], plain[ord(char.lower()[0])] = char.lower(), out or char.lower()
        else:
            table[code] = out or " "
    return table, plain


class Folder:
    """Folds texts; its tables are made where it is used, not sent."""

    def __init__(self):
        self.table: dict[int, str | None] | None = None

    def __reduce__(self):
        return (Folder, ())

    def __call__(self, text: str | None) -> tuple[list[str], list[str]]:
        """The folded words of a text, with and without accents."""
        if self.table is None:
            self.table, self.plain = _folding()
        text = text or ""
        if text.isascii():
            words = text.translate(self.table).split()
            return words, words
        line = unicodedata.normalize("NFC", text).translate(self.table)
        words = line.split()
        return words, words if line.isascii() else [w if w.isascii() else w.translate(self.plain) for w in words]


def terms(words: list[str], plain: list[str]) -> set[str]:
    """The entries that a text's words may give: words of at most 16 letters with a full stop, and their beginnings."""
    out = set()
    for w in set(words) | set(plain):
        if 3 <= len(w) <= 16:
            out.add(w + ".")
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n])
    return out


def choose_entries(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: int = 4, odds: float = 6.0) -> dict[str, float]:
    """``{entry: log odds}`` from ``(term, toxic documents, clean documents)`` with the term.

    Terms seen in ``least`` toxic documents, ``odds`` times as often as in clean ones, from the most
    telling on; one that begins another chosen one, or is begun by it, isn't taken again.
    """
    rated = []
    for term, n1, n0 in counts:
        ratio = math.log(((n1 + 0.5) / (toxic + 1)) / ((n0 + 0.5) / (clean + 1)))
        if n1 >= least and ratio >= math.log(odds):
            rated.append((-n1 * ratio, -len(term), term, ratio))
    chosen: dict[str, float] = {}
    for _, _, term, ratio in sorted(rated):
        bare = term.rstrip(".")
        if not any(bare.startswith(c.rstrip(".")) or c.rstrip(".").startswith(bare) for c in chosen):
            chosen[term] = ratio
            if len(chosen) == MOST_ENTRIES:
                break
    return chosen


class Matcher:
    """Finds entries in folded words, but for those inside an exception phrase. Its automata are built where they are used."""

    def __init__(self, entries: dict[str, float], exceptions: set[str]):
        self.entries, self.exceptions, self.built = entries, exceptions, None

    def __reduce__(self):
        return (Matcher, (self.entries, self.exceptions))

    def hits(self, words: list[str], plain: list[str]) -> list[tuple[str, str]]:
        """``(entry, phrase)`` of each hit; the phrase is the word before, the word hit and the word after, without accents."""
        import ahocorasick

        if self.built is None:
            self.built = ahocorasick.Automaton()
            for entry in self.entries:
                self.built.add_word(" " + (entry[:-1] + " " if entry.endswith(".") else entry), entry)
            if self.entries:
                self.built.make_automaton()
        if not self.entries or not words:
            return []
        found = set()
        for form in (words,) if words is plain else (words, plain):
            starts = None
            for end, entry in self.built.iter(" " + " ".join(form) + " "):
                if starts is None:
                    starts = np.cumsum([1] + [len(w) + 1 for w in form])
                found.add((int(np.searchsorted(starts, end - len(entry) + 1, side="right")) - 1, entry))
        phrases = [(entry, " ".join(plain[max(0, at - 1) : at + 2])) for at, entry in sorted(found)]
        return [(e, p) for e, p in phrases if p not in self.exceptions]


def features(hits: list[tuple[str, str]], n_words: int, entries: dict[str, float]) -> list[float]:
    """What the scale reads: the weight of the hits, their weight by length, and how many different entries they are."""
    weight = sum(entries[e] for e, _ in hits)
    return [math.log1p(weight), math.log1p(1000 * weight / (n_words + 20)), math.log1p(len(hits)), math.log1p(len({e for e, _ in hits})), math.log1p(n_words) / 8]


def fit_scale(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a logistic regression by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, 6))
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + ridge * len(y) * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + (ridge * len(y) + 1e-9) * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS) -> tuple[Matcher, np.ndarray]:
    """The lexicon with its exceptions, and the scale, learned from at most ``sample_docs`` labelled documents.

    They are the first by a hash of doc_id among rows whose crc32(doc_id as text) modulo ``mod`` is
    not ``held_out``. Without labelled rows the lexicon is empty and every score the same.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_mod("doc_id", mod) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    # at most sample_docs rows of two numbers: bounded, so broadcast
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    chosen = ids_and_texts(docs).join(sample, "doc_id").select("doc_id", "y", "text")
    fold = Folder()

    def emit(batches):
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = [*terms(*fold(text.as_py())), ""]  # "": the document itself
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([y] * len(found), pa.int32())], ["term", "y"])

    counted = chosen.mapInArrow(emit, "term string, y int").groupBy("term").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    counts = [(r["term"], r["n1"], r["n0"]) for r in counted.where("n1 >= 4 and n1 * 2 >= n0 or term = ''").collect()]  # terms of a bounded sample
    toxic, clean = next(((n1, n0) for t, n1, n0 in counts if t == ""), (0, 0))
    entries = choose_entries([c for c in counts if c[0]], toxic, clean)
    plain = Matcher(entries, set())

    def look(batches):
        for batch in batches:
            rows = []
            for doc, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, bare = fold(text.as_py())
                hits = plain.hits(words, bare)
                rows.append((doc, y, len(words), [e for e, _ in hits], [p for _, p in hits]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "y", "n", "entries", "phrases"])

    seen = chosen.mapInArrow(look, "doc_id long, y int, n long, entries array<string>, phrases array<string>").toArrow().to_pylist()
    seen.sort(key=lambda r: (r["doc_id"], r["n"]))
    harmless, harmful = Counter(), Counter()
    for r in seen:
        (harmful if r["y"] else harmless).update(set(r["phrases"]))
    exceptions = {p for p, n in harmless.items() if n >= 3 and n >= 3 * harmful[p]}
    # weights anew, by documents in which an entry stands outside exceptions
    with1, with0 = Counter(), Counter()
    for r in seen:
        (with1 if r["y"] else with0).update({e for e, p in zip(r["entries"], r["phrases"], strict=True) if p not in exceptions})
    entries = {e: max(0.5, math.log(((with1[e] + 0.5) / (toxic + 1)) / ((with0[e] + 0.5) / (clean + 1)))) for e in entries}
    x = [features([(e, p) for e, p in zip(r["entries"], r["phrases"], strict=True) if p not in exceptions], r["n"], entries) for r in seen]
    return Matcher(entries, exceptions), fit_scale(np.array(x, np.float64).reshape(len(x), 5), np.array([r["y"] for r in seen], np.float64))


def score(docs: DataFrame, matcher: Matcher, scale: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 from the whole text alone, and ``hits``, how often entries occur.

    A null text is empty; an empty one has no hit and the score of that. Columns of these names are
    replaced, others pass through; repeated rows have equal scores.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "hits")
    text, fold = docs.columns.index("text"), Folder()

    def run(batches):
        for batch in batches:
            scores, counts = [], []
            for value in batch.column(text):
                words, bare = fold(value.as_py())
                hits = matcher.hits(words, bare)
                x = float(np.dot([*features(hits, len(words), matcher.entries), 1.0], scale))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], [*batch.schema.names, "score", "hits"])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema.fields)).add("score", "double").add("hits", "long"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 3, held_out: int = 1, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, hits)`` of each row of ``docs``."""
    matcher, scale = fit(docs, labels, mod, held_out, sample_docs)
    scored = score(docs.select("doc_id", "text"), matcher, scale)
    return scored.select("doc_id", (crc_mod("doc_id", mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
