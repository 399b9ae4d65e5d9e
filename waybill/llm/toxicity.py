"""Toxicity by a weighted finite-state pattern grammar over clauses.

Three machines are composed:

1. *Lexicon*: an Aho-Corasick automaton over characters reads a text and writes INSULT, THREAT or nothing for each word. Its words
   and word beginnings are a fixed list and what the labels teach (``learn_lexicon``).
2. *Roles*: in a clause that has such a word, each word becomes one of INSULT, THREAT, TARGET, NEGATION, REPORT or OTHER.
3. *Grammar*: a transducer reads the roles of a clause from left to right. Its state is whether the clause has a target, whether a
   negation reaches this far, and whether the speech is reported. For an insult or threat it writes the ``SYMBOLS`` that
   hold in its state; the clause is worth the weights of its symbols.

A document's score is the logistic value of its clause weights. Starting weights say what the grammar means (negated and reported
clauses count less, aimed ones more); the labels move them as far as there is evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.base import stored, unused

# The built-in word lists, in English, German, French and Spanish.
INSULTS = ("idiot moron stupid scum loser trash worthless pathetic disgusting clown imbecile bastard idiota imbecil "
           "estupido basura dummkopf abschaum trottel arschloch connard salaud abruti ordure").split()  # fmt: skip
THREATS = "kill murder destroy strangle shoot umbringen töten vernichten tuer détruire matar destruir".split()
TARGETS = ("you your yours youre he she they them him her his their du dich dir dein deine ihr euch sie er tu te toi ton ta vous "
           "votre il elle ils usted ustedes tú ti su él ella ellos").split()  # fmt: skip
NEGATIONS = "not no never without isnt arent dont nicht kein keine nie niemals ne pas jamais sans nunca sin jamás".split()
REPORTS = ("said says say called calls wrote quoted reported claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice "
           "llamó escribió").split()  # fmt: skip

#: How many words a negation reaches.
REACH = 3
#: What the grammar writes for an insult or threat: its kind, and whether it is aimed, negated or reported; and starting weights.
SYMBOLS = ("insult", "threat", "aimed", "negated", "reported")
PRIOR = (4.5, 3.0, 0.5, -1.5, -1.0)
#: Starting value of a document without any matched clause, and how many documents the starting weights are worth.
BIAS, STRENGTH = -3.0, 1.0
#: Counts of a symbol above this say no more.
MOST = 3
#: Labelled rows used to fit, at most about.
FIT_ROWS = 200_000
#: A learned pattern may have this share of hits in documents that are not toxic.
IMPURE = 0.02
#: How often the toxic documents that no pattern explains yet are looked at.
ROUNDS = 3
#: Shortest and longest beginning of a word that is learned.
STEM = (4, 8)

_CLAUSE = re.compile(r"[.!?;:,\n]+")
_WORD = re.compile(r"\w+")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept for testing: a fifth by crc32 of the id; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Grammar:
    """The composed machine. patterns: word -> kind, and beginning + '*' -> kind."""

    def __init__(self, patterns: dict[str, str]):
        self.lexicon = ahocorasick.Automaton()
        for pattern, kind in patterns.items():
            self.lexicon.add_word(" " + (pattern[:-1] if pattern.endswith("*") else pattern + " "), kind)
        if patterns:
            self.lexicon.make_automaton()
        self.patterns = patterns
        self.roles = {w: "report" for w in REPORTS} | {w: "negation" for w in NEGATIONS} | {w: "target" for w in TARGETS}
        self.stems = sorted({len(p) - 1 for p in patterns if p.endswith("*")})

    def kind(self, word: str) -> str | None:
        found = self.patterns.get(word)
        for n in self.stems:
            found = found or self.patterns.get(word[:n] + "*") if len(word) >= n else found
        return found

    def clause(self, words: list[str]) -> list[int]:
        """The symbols that the transducer writes for a clause, as places in SYMBOLS."""
        roles = [self.kind(w) or self.roles.get(w) for w in words]
        aimed, reported, reach, out = "target" in roles, False, 0, []
        for role in roles:
            if role == "report":
                reported = True
            elif role == "negation":
                reach = REACH + 1
            elif role in ("insult", "threat"):
                holds = (role == "insult", role == "threat", aimed, reach > 0, reported)
                out += [k for k, h in enumerate(holds) if h]
            reach = max(0, reach - 1)
        return out

    def features(self, text: str | None) -> tuple[int, ...]:
        """How often each symbol is written in a text, up to MOST."""
        counts = [0] * len(SYMBOLS)
        if not text or not self.patterns:
            return tuple(counts)
        lower = text.lower()
        flat = " " + " ".join(_WORD.findall(lower)) + " "
        if next(self.lexicon.iter(flat), None) is None:  # no word of the lexicon in the whole text
            return tuple(counts)
        for part in _CLAUSE.split(lower):
            words = _WORD.findall(part)
            if any(self.kind(w) for w in words):
                for s in self.clause(words):
                    counts[s] = min(MOST, counts[s] + 1)
        return tuple(counts)


def learn_lexicon(labelled: DataFrame) -> dict[str, str]:
    """The fixed words, and words and word beginnings that only toxic texts of ``labelled`` (text, toxic) have.

    A pattern is learned if so many toxic documents have it that chance would not bring about one such pattern among all that
    were looked at, and next to no others do. Of beginnings that tell as much the shortest is kept. Toxic documents
    without a learned pattern are then looked at again by themselves. Equal texts of a class count once; every different
    text counts, whatever lines it shares with others. The driver holds the learned patterns only.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    once = stored(
        labelled.groupBy(F.sha2("text", 256).alias("same"), "toxic")
        .agg(F.first("text").alias("text"))
        .select("toxic", F.filter(words, lambda w: F.length(w) >= 3).alias("words")),
        "toxicity-words",
    )
    fixed = {w: "insult" for w in INSULTS} | {w: "threat" for w in THREATS}
    sums = once.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("docs")).first()
    bad, docs = sums["bad"] or 0, sums["docs"] or 0
    if not bad or bad == docs:
        return fixed

    def patterns(word: F.Column) -> F.Column:
        """A word and its beginnings; a beginning has a star."""
        begun = F.transform(
            F.sequence(F.lit(STEM[0]), F.lit(STEM[1])),
            lambda n: F.when(F.length(word) >= n, F.concat(F.substring(word, F.lit(1), n), F.lit("*"))),
        )
        return F.array_compact(F.array_append(begun, word))

    clean = stored(
        once.where("toxic = 0").select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("hits")),
        "toxicity-clean",
    ).select(F.explode(patterns(F.col("word"))).alias("pattern"), "hits")
    learned: dict[str, str] = {}
    toxic = once.where("toxic = 1")
    for _ in range(ROUNDS):
        found = (
            toxic.select(F.explode(F.array_distinct(F.flatten(F.transform("words", patterns)))).alias("pattern"))
            .groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("bad"))
        )
        found = stored(found.where("bad > 1"), "toxicity-patterns")
        least = (math.log(found.count() + 1) + 2) / math.log(docs / bad)
        found = found.where(F.col("bad") >= max(3, least))
        others = clean.join(found, "pattern", "left_semi").groupBy("pattern").agg(F.sum("hits").alias("hits"))
        pure = found.join(others, "pattern", "left").where(F.coalesce("hits", F.lit(0)) <= F.col("bad") * IMPURE)
        new = _shortest(r["pattern"] for r in pure.select("pattern").collect())
        if not new:
            break
        learned |= new
        toxic = stored(toxic.where(~_matched(F.col("words"), learned)), "toxicity-left")
        bad = toxic.count()
        if not bad:
            break
    return fixed | learned


def _shortest(patterns: Iterable[str]) -> dict[str, str]:
    """The patterns that no shorter beginning among them covers."""
    out: dict[str, str] = {}
    for pattern in sorted(patterns, key=lambda p: (len(p), p)):
        stem = pattern.rstrip("*")
        if not any(stem[:n] + "*" in out for n in range(1, len(stem) + 1)):
            out[pattern] = "insult"
    return out


def _matched(words: F.Column, patterns: dict[str, str]) -> F.Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(patterns)
        for batch in batches:
            yield pd.Series([any(grammar.kind(w) for w in words) for words in batch], dtype=bool)

    return run(words)


def fit_weights(cells: list[tuple[tuple[int, ...], int, int]]) -> np.ndarray:
    """Logistic weights (bias first) from counted cells (features, toxic, documents), drawn towards the starting weights."""
    prior = np.array([BIAS, *PRIOR])
    if not cells:
        return prior
    x = np.array([[1, *f] for f, _, _ in cells], dtype=float)
    y, n = np.array([t for _, t, _ in cells], dtype=float), np.array([c for _, _, c in cells], dtype=float)
    w, pull = prior.copy(), np.full(len(prior), STRENGTH)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + pull * (w - prior)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[dict[str, str], list[float]]:
    """Lexicon and weights from the labels (doc_id, toxic) of documents that are not held out.

    Of more than ``rows`` labels a share is used, chosen by a hash of the id; a document with several labels counts as toxic if one
    says so. The labels used are a bounded number, so they go to the documents and the texts stay where they are.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    count = known.count()
    if count > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / count))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull())
    patterns = learn_lexicon(labelled.select("text", "toxic"))
    cells = labelled.select(symbols(F.col("text"), patterns).alias("found"), "toxic").groupBy("found", "toxic").count()
    counted = [(tuple(r["found"]), r["toxic"], r["count"]) for r in cells.collect()]  # at most (MOST + 1) ** len(SYMBOLS) cells
    return patterns, [float(w) for w in fit_weights(counted)]


def symbols(text: F.Column, patterns: dict[str, str]) -> F.Column:
    """The counts of the grammar's symbols in a text column."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(patterns)
        for batch in batches:
            yield pd.Series([list(grammar.features(t)) for t in batch])

    return run(text)


def score(text: F.Column, patterns: dict[str, str], weights: list[float]) -> F.Column:
    """How likely a text column is toxic, from 0 to 1; null and empty texts have no clause and get the bias alone."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar, seen = Grammar(patterns), {}
        for batch in batches:
            out = []
            for text in batch:
                found = grammar.features(text)
                if found not in seen:
                    value = weights[0] + sum(w * n for w, n in zip(weights[1:], found, strict=True))
                    seen[found] = 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))
                out.append(seen[found])
            yield pd.Series(out, dtype=float)

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row of ``docs`` (doc_id, text).

    Learned from the labels of documents not held out; without any, the built-in lists and weights score. Null and empty texts score
    the bias. Repeated rows score alike. An empty table gives no rows. Other columns play no part.
    """
    patterns, weights = fit(docs, labels, rows)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), patterns, weights).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``toxicity`` does not predict to be toxic."""
    (name,) = unused(docs, "score")
    patterns, weights = fit(docs, labels, rows)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(name, score(F.col("text"), patterns, weights)).where(F.col(name) < 0.5).select(*columns)
