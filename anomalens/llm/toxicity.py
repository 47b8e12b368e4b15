"""Toxicity from a learned lexicon, its misspellings and their context.

Words that occur in toxic documents far oftener than chance allows form the lexicon,
a trie with one weight per term. A text is cut at blanks; every distinct token, without
its outer punctuation but with inner digits and symbols, and if it holds several words
each of these, is run through the trie by a Levenshtein automaton (``EDITS`` edits, a
swap of neighbours is one, for terms of ``FUZZY_LENGTH`` letters on; a term shorter than
``MEASURED_LENGTH`` only if its misspellings stand in at most ``MOST_FALSE`` of the
sample's clean documents). An exact test (words one edit apart share what a deletion
leaves of them) spares most words the walk, and the others all terms but a few. Hits inside a pair of quotation marks count as quotation,
the others as abuse; words of report are not looked at. Marks are paired over the whole
text, and a text with no word outside its pairs quotes nothing. A logistic fit over
these counts gives the score.

The fit uses at most ``PER_CLASS`` labelled documents of each class. For the fit, the
hits in one half of the sample come from the lexicon of the other half.

Defined cases: null and empty texts have a score like any text without hits; without
labelled rows the lexicon is empty and every score is 0.5; a null key is not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm.common import packed, unpacked
from anomalens.llm.training import labelled, lasso_logistic, remainder, sigmoid
from anomalens.plans.storage import cut_lineage

PER_CLASS = 10_000
EDITS, FUZZY_LENGTH = 1, 3
MEASURED_LENGTH, MOST_FALSE = 5, 0.002
SIGNIFICANCE, LEAST_DOCS, LEAST_ODDS = 12.0, 3, 3.0
# Tokens and words whose answers a task keeps; each is some 250 bytes, in every worker.
_CACHED = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_TRIMMED = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
_PIECE = re.compile(r"[^,;:/\\…—–\"“”„«»()\[\]{}<>]+")
_KEPT_LENGTH = 40
# Not the apostrophes inside a word, nor those for letters left out before one.
_QUOTE = re.compile(r"[\"“”„«»]|(?<!\w)['‘’‚]|['‘’‚](?!\w)")
_ELISION = re.compile(r"(?:tis|twas|cause|em|til|bout|round|n|\d0s)\b")
# Per closing mark the marks that it may close; habits differ between languages.
_CLOSES = {'"': '"', "'": "'", "”": "“„”", "“": "„", "»": "«»", "«": "»", "’": "‘‚’", "‘": "‚"}
_LEADING = frozenset("([{-–—/=:\"'“”„«»‘’‚")
FEATURES = ("abuse", "abuse_misspelt", "quoted", "density", "heaviest", "terms", "total")


class Lexicon:
    """A trie of terms with weights, and its intersection with the Levenshtein
    automaton of a word. The automaton's state is a row of edit distances cut at
    ``edits``; a branch is left as soon as no distance in the row is allowed."""

    def __init__(self, terms: dict[str, float], edits: int = EDITS, fuzzy: int = FUZZY_LENGTH, swaps: bool = False,
                 strict: frozenset[str] = frozenset()) -> None:
        self.terms, self.edits, self.fuzzy, self.swaps, self.strict = terms, edits, fuzzy, swaps, strict
        self.longest = max(map(len, terms), default=0)
        self.root = _trie(terms)
        self.shortened: dict[str, list[str]] = {}
        for term in terms:
            if len(term) >= fuzzy and term not in strict:
                for short in _shortened(term):
                    self.shortened.setdefault(short, []).append(term)
        self._kept: dict[str, tuple[str, int] | None] = {}
        self._tokens: dict[str, tuple[int, tuple]] = {}

    def hits(self, token: str) -> tuple[int, tuple[tuple[int, str, int], ...]]:
        """The number of words in a token and its hits: place, term and distance."""
        found = self._tokens.get(token)
        if found is None:
            found = self._hits(token)
            if len(token) <= _KEPT_LENGTH:
                if len(self._tokens) >= _CACHED:
                    self._tokens.clear()
                self._tokens[token] = found
        return found

    def _hits(self, token: str) -> tuple[int, tuple[tuple[int, str, int], ...]]:
        pieces = [(p.start() + m.start(), m.group()) for p in _PIECE.finditer(token)
                  if (m := _TRIMMED.search(p.group()))]
        out = [hit for at, piece in pieces for hit in self._piece(at, piece)]
        whole = _TRIMMED.search(token)
        if not out and len(pieces) > 1 and (near := self.match(whole.group())):
            out = [(whole.start(), *near)]
        return len(_WORD.findall(token)), tuple(out)

    def _piece(self, at: int, piece: str) -> list[tuple[int, str, int]]:
        # Words spelt right come before a piece that is one word misspelt.
        near = self.match(piece)
        if near and near[1] == 0:
            return [(at, *near)]
        words = [(at + m.start(), *found) for m in _WORD.finditer(piece) if (found := self.match(m.group()))]
        return words if not near or any(distance == 0 for _, _, distance in words) else [(at, *near)]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, or None."""
        found = self._kept.get(word, 0)
        if found == 0:
            if len(self._kept) >= _CACHED:
                self._kept.clear()
            found = self._kept[word] = self._match(word)
        return found

    def _match(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        if not self.edits or not self.fuzzy - self.edits <= len(word) <= self.longest + self.edits:
            return None
        if self.edits == 1:
            near = {term for short in _shortened(word) for term in self.shortened.get(short, ())}
            return self.nearest(word, _trie(near)) if near else None
        return self.nearest(word)

    def nearest(self, word: str, root: dict | None = None) -> tuple[str, int] | None:
        """The walk itself: the trie (or that of some terms) and automaton step together."""
        best: tuple[int, str] | None = None
        stack = [(root or self.root, tuple(range(len(word) + 1)), None, "")]
        while stack:
            node, row, above, last = stack.pop()
            term = node.get("")
            if term is not None and row[-1] <= self.edits and (
                    row[-1] == 0 or len(term) >= self.fuzzy and term not in self.strict):
                best = min(best, (row[-1], term)) if best else (row[-1], term)
            for letter, child in node.items():
                if letter:
                    step = self._step(row, letter, word, above, last)
                    if min(step) <= self.edits:
                        stack.append((child, step, row, letter))
        return (best[1], best[0]) if best else None

    def _step(self, row: tuple, letter: str, word: str, above: tuple | None = None, last: str = "") -> tuple:
        most = self.edits + 1
        out = [min(row[0] + 1, most)]
        for i, own in enumerate(word):
            out.append(min(row[i] + (own != letter), row[i + 1] + 1, out[i] + 1, most))
            if self.swaps and above and i and own == last and word[i - 1] == letter:
                out[-1] = min(out[-1], above[i - 1] + 1)
        return tuple(out)


def _trie(terms) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = term
    return root


def _shortened(word: str) -> set[str]:
    """The word and what the deletion of one letter leaves of it."""
    return {word, *(word[:i] + word[i + 1:] for i in range(len(word)))}


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    bias: float = 0.0
    scale: tuple[float, ...] = field(default=(1.0,) * len(FEATURES))
    strict: frozenset[str] = frozenset()  # short terms that stand for no misspelling


def features_of(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    lower = text.lower()
    found = list(map(lexicon.hits, lower.split()))
    hits = [hit for _, own in found for hit in own]
    if not hits:
        return (0.0,) * len(FEATURES)
    words = sum(many for many, _ in found)
    abuse = misspelt = quoted = 0
    total, heaviest, terms = 0.0, 0.0, set()
    pairs = _pairs(lower)
    places = [m.start() + at for m, (_, own) in zip(_TOKEN.finditer(lower), found) for at, _, _ in own] if pairs else []
    inside = _quoted(places, pairs, lower) if pairs else [False] * len(hits)
    for (_, term, distance), quote in zip(hits, inside):
        weight = lexicon.terms[term] * (0.5 if distance else 1.0)
        if quote:
            quoted += 1
            continue
        abuse += distance == 0
        misspelt += distance > 0
        total += weight
        heaviest = max(heaviest, weight)
        terms.add(term)
    return (np.log1p(abuse), np.log1p(misspelt), np.log1p(quoted), (abuse + misspelt) / max(1, words) ** 0.5,
            heaviest, np.log1p(len(terms)), np.log1p(total))


def _pairs(text: str) -> list[tuple[int, int]]:
    """The places of opening and closing marks that belong together. An opening mark
    that is never closed quotes nothing; one that is repeated at the start of a line
    goes on with the quotation, elsewhere it starts another in its place."""
    at: dict[str, int] = {}
    out = []
    for m in _QUOTE.finditer(text):
        i, mark = m.start(), m.group()
        free = not i or text[i - 1].isspace() or text[i - 1] in _LEADING
        leads = free and i + 1 < len(text) and not text[i + 1].isspace()
        mates = [at[o] for o in _CLOSES.get(mark, "") if o in at]
        if mates and not (mark in at and leads):
            low = max(mates)
            at = {o: p for o, p in at.items() if p < low}
            out.append((low, i))
        elif mark in "'‘’" and _ELISION.match(text, i + 1):
            continue
        elif (leads or free and mark in '"“„«') and not (mark in at and _heads_line(text, i)):
            at[mark] = i
    return out


def _heads_line(text: str, at: int) -> bool:
    while at and text[at - 1] in " \t":
        at -= 1
    return not at or text[at - 1] == "\n"


def _quoted(places: list[int], pairs: list[tuple[int, int]], text: str) -> list[bool]:
    """Whether each place lies inside a pair, in a text with words outside its pairs."""
    depth = np.zeros(len(text) + 1, np.int32)
    for low, high in pairs:
        depth[low] += 1
        depth[high] -= 1
    inside = np.cumsum(depth) > 0
    if all(inside[m.start()] for m in _WORD.finditer(text)):
        return [False] * len(places)
    return inside[places].tolist()


def count_words(sample: DataFrame) -> DataFrame:
    """(w, part, whole, a, n): per word and half of the sample the toxic and all
    documents that have it; ``whole`` marks short tokens with inner digits or symbols."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, all_ = Counter(), Counter()
            for text, y, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lower = text.lower()
                words = {(w, part, False) for w in _WORD.findall(lower)}
                for token in set(lower.split()):
                    short = _TRIMMED.search(token)
                    if short and len(short.group()) <= MEASURED_LENGTH and not _WORD.fullmatch(short.group()):
                        words.add((short.group(), part, True))
                all_.update(words)
                if y:
                    toxic.update(words)
            keys = list(all_)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                   pa.array([k[2] for k in keys], pa.bool_()), pa.array([toxic[k] for k in keys], pa.int64()),
                                   pa.array([all_[k] for k in keys], pa.int64())], names=["w", "part", "whole", "a", "n"])

    return cut_lineage(sample.select("text", "y", "part").mapInArrow(
        count, "w string, part int, whole boolean, a bigint, n bigint").groupBy("w", "part", "whole").agg(
        F.sum("a").alias("a"), F.sum("n").alias("n")))


def strict_terms(sample: DataFrame, counted: DataFrame, terms: dict[str, float], most: float = MOST_FALSE) -> frozenset[str]:
    """The short terms whose misspellings stand in too many clean documents."""
    short = {t: w for t, w in terms.items() if FUZZY_LENGTH <= len(t) < MEASURED_LENGTH}
    clean = sample.filter("y = 0").count() if short else 0
    if not clean:
        return frozenset()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(short, swaps=True)
        alone = {t: Lexicon({t: 1.0}, swaps=True) for t in short}
        for batch in batches:
            false: Counter = Counter()
            for word, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in terms:
                    for term in {t for s in _shortened(word) for t in lexicon.shortened.get(s, ())}:
                        if alone[term].nearest(word):
                            false[term] += many
            yield pa.record_batch([pa.array(list(false), pa.string()), pa.array(list(false.values()), pa.int64())],
                                  names=["term", "false"])

    words = counted.filter((F.col("n") > F.col("a")) & (F.length("w") <= MEASURED_LENGTH)).select(
        "w", (F.col("n") - F.col("a")).alias("b"))
    found = words.mapInArrow(near, "term string, false bigint").groupBy("term").agg(F.sum("false").alias("false"))
    return frozenset(r.term for r in found.filter(F.col("false") > most * clean).collect())


def learn_terms(sample: DataFrame, counted: DataFrame, parts: list[int]) -> dict[str, float]:
    """Terms by the likelihood ratio of their document counts in both classes."""
    sizes = sample.filter(F.col("part").isin(parts)).agg(F.count("*"), F.sum("y")).first()
    n, n1 = int(sizes[0]), int(sizes[1] or 0)
    if not 0 < n1 < n:
        return {}
    found = counted.filter(F.col("part").isin(parts) & ~F.col("whole")).groupBy("w").agg(
        F.sum("a").alias("a"), F.sum("n").alias("n")).filter(F.col("a") >= LEAST_DOCS)
    share = n1 / n
    a, b, m = F.col("a"), F.col("n") - F.col("a"), F.col("n")
    ratio = 2 * (a * F.log(a / (m * share)) + F.when(b > 0, b * F.log(b / (m * (1 - share)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n - n1 + 1)))
    # Log odds of 3 keep words that are twenty times as frequent in toxic documents.
    found = found.withColumn("ratio", ratio).withColumn("odds", odds).filter(
        (F.col("ratio") >= SIGNIFICANCE) & (a / n1 > b / (n - n1)))
    return {r.w: float(r.odds) for r in found.collect() if r.odds >= min(LEAST_ODDS, _least(r.a))}


def _least(docs: int) -> float:
    # A term seen in few documents cannot reach high odds, whatever it means.
    return max(1.5, float(np.log(2 * docs)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held_out: int = 1,
          text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS, penalty: float = 0.0005) -> Model:
    """Learn the lexicon and the weights from labelled rows whose remainder is not
    ``held_out``. The driver sees the lexicon and one row of counts per sample row."""
    sample = labelled(docs, labels, label, remainder(key, parts) != held_out, per_class, text, key)
    sample = cut_lineage(sample.withColumn("part", F.pmod(F.xxhash64("k", F.lit("part")), F.lit(2)).cast("int")))
    counted = count_words(sample)
    halves, terms = [learn_terms(sample, counted, [p]) for p in (1, 0)], learn_terms(sample, counted, [0, 1])
    strict = strict_terms(sample, counted, {**halves[0], **halves[1], **terms})
    rows = sample.select("k", "y", "part", "text").mapInArrow(
        _featured([Lexicon(t, swaps=True, strict=strict) for t in halves]), "k string, y int, part int, " + ", ".join(
            f"{f} double" for f in FEATURES)).toPandas().sort_values(["k", *FEATURES])
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)
    if not len(y):
        return Model({})
    scale = np.maximum(x.std(axis=0), 1e-6)
    weights, bias = lasso_logistic(x / scale, y, penalty)
    share = labels.filter(remainder(key, parts) != held_out).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    if 0 < y.mean() < 1 and 0 < share < 1:  # back to the share of toxic rows before the bound
        bias += float(np.log(share / (1 - share) * (1 - y.mean()) / y.mean()))
    return Model(terms, tuple(map(float, weights)), bias, tuple(map(float, scale)), strict)


def _featured(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, texts = batch.column(2).to_pylist(), batch.column(3)
            x = np.array([features_of(t.as_py(), lexicons[p]) for t, p in zip(texts, part)]).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2),
                                   *[pa.array(x[:, j]) for j in range(len(FEATURES))]],
                                  names=["k", "y", "part", *FEATURES])
    return run


def toxic_score(text: Column, model: Model) -> Column:
    """The score (0 to 1) of a text column."""
    weights, scale = np.array(model.weights), np.array(model.scale)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(model.terms, swaps=True, strict=model.strict)
        for batch in batches:
            # One text at a time: a batch may be any number of MB, and is not held twice.
            x = np.array([features_of(t.as_py() or "", lexicon) for t in batch]).reshape(-1, len(FEATURES))
            yield pa.array(sigmoid((x / scale) @ weights + model.bias), pa.float64())
    return run.asNondeterministic()(text)


def score(docs: DataFrame, model: Model, text: str = "text", parts: int = 3, held_out: int = 1, key: str = "doc_id",
          threshold: float = 0.7) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted``."""
    rows = packed(docs, score=toxic_score(F.col(text), model), part=remainder(key, parts))
    return unpacked(rows, held_out=F.coalesce(F.col("part") == held_out, F.lit(False)), score=F.col("score"),
                    predicted=(F.col("score") >= threshold).cast("int"))
