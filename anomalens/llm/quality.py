"""Document quality by a sparse rule ensemble (after RuleFit).

Shallow boosted trees over statistics of the text are grown on a bounded sample of
labelled rows; every path from a root becomes a conjunction of thresholds; a lasso
logistic fit keeps few of them. The rules that are left are compiled into one Spark
column expression over the statistics.

At most ``PER_CLASS`` labelled documents of each class are used for the fit. The
statistics are of whole texts and of bytes, words and lines only, never of the key,
language or source.

Defined cases: null and empty texts have statistics of zero and a score; without
labelled rows every score is 0.5; labels other than 0 and 1 are left out, of several
labels of a key the largest counts; a null key is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm import buffers
from anomalens.llm.training import labelled, lasso_logistic, remainder

PER_CLASS = 10_000
TREES, DEPTH, BINS = 60, 3, 32
PENALTY = 0.0008

STATISTICS = ("bytes", "words", "lines", "mean_word", "long_words", "letters", "upper", "digits", "points", "symbols",
              "pipes", "beyond_ascii", "line_ends", "distinct_words", "repeated_lines", "words_per_line",
              "short_lines", "no_letter_words", "symbol_ends", "sentence_ends", "capital_words")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER | _class(bytes(range(97, 123))) | _class(bytes(range(128, 256)))
_DIGIT = _class(bytes(range(48, 58)))
_POINT = _class(b".,;:!?'\"()-")
_BLANK = _class(b" \t\n\r\v\f")
_SYMBOL = ~(_LETTER | _DIGIT | _POINT | _BLANK)
_END = _class(b".!?")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    data, offsets = buffers.texts(column)
    parts = [_statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
             for a, b in buffers.pieces(offsets, 1 << 21)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    size = np.diff(bounds).astype(np.float64)
    starts, ends = buffers.word_spans(data, bounds)
    owner = np.searchsorted(bounds, starts, "right") - 1
    at = np.searchsorted(starts, bounds)  # words before each text
    words = np.diff(at).astype(np.float64)
    per_word, per_byte = np.maximum(words, 1.0), np.maximum(size, 1.0)
    hashes = buffers.word_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    letters = _LETTER[data]
    before = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    bare = before[ends] == before[starts]
    # Lines that hold words; equal lines have equal sums of word hashes.
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    line = breaks[starts] + owner  # rises at each line end and at each text
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(line)))
    place = np.arange(len(line)) - np.repeat(first, many)
    sums = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), first) if len(first) else hashes[:0]
    whose = owner[first]
    lines = np.bincount(whose, minlength=n).astype(np.float64)
    rank = np.lexsort((sums, whose))
    same = np.zeros(len(rank), bool)
    same[1:] = (sums[rank][1:] == sums[rank][:-1]) & (whose[rank][1:] == whose[rank][:-1])
    repeated = np.bincount(whose[rank][same], minlength=n)
    per_line = np.maximum(lines, 1.0)
    last = data[ends - 1] if len(ends) else data[:0]
    head = data[starts] if len(starts) else data[:0]

    def by_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / per_word

    def by_byte(table: np.ndarray) -> np.ndarray:
        return _sums(table[data], bounds) / per_byte

    return np.column_stack([
        size, words, lines, _sums(ends - starts, at) / per_word, by_word(ends - starts > 20),
        by_byte(_LETTER), by_byte(_UPPER), by_byte(_DIGIT), by_byte(_POINT), by_byte(_SYMBOL), by_byte(_class(b"|")),
        by_byte(_class(bytes(range(128, 256)))), by_byte(_class(b"\n")), distinct / per_word, repeated / per_line,
        words / per_line, np.bincount(whose[many < 4], minlength=n) / per_line, by_word(bare),
        by_word(_SYMBOL[last]), by_word(_END[last]), by_word(_UPPER[head])])


def with_statistics(rows: DataFrame) -> DataFrame:
    """Replace the column ``text`` by one double per statistic."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
                       + [f"{s} double" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(batch.column(len(kept)))
            yield pa.record_batch([batch.column(i) for i in range(len(kept))] + [
                pa.array(found[:, j]) for j in range(len(STATISTICS))], names=[*kept, *STATISTICS])
    return rows.select(*kept, "text").mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for statistic, above, limit in rule:
                c = F.col(STATISTICS[statistic])
                holds = holds & ((c > limit) if above else (c <= limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for statistic, above, limit in rule:
        out &= (x[:, statistic] > limit) if above else (x[:, statistic] <= limit)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
               seed: int = 5) -> list[Rule]:
    """The paths of boosted trees: each tree is grown on half of the rows and
    of the statistics, against what the trees before leave unexplained."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    score, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = rng.random(len(y)) < 0.5
        some = [j for j in rng.permutation(x.shape[1])[:max(2, x.shape[1] // 2)] if len(cuts[j])]
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        for _level in range(depth):
            grown = []
            for rule, inside in nodes:
                at = inside & rows
                best = (1e-6, None, None)
                total, weight = slope[at].sum(), curve[at].sum()
                if at.sum() >= 20:
                    for j in some:
                        g = np.cumsum(np.bincount(code[at, j], slope[at], len(cuts[j]) + 1))[:-1]
                        h = np.cumsum(np.bincount(code[at, j], curve[at], len(cuts[j]) + 1))[:-1]
                        gain = g ** 2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total ** 2 / (weight + 1)
                        gain[(h < 0.05) | (weight - h < 0.05)] = 0.0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] is None:
                    score[inside] += 0.3 * total / (weight + 1.0)
                    continue
                j, limit = best[1], float(cuts[best[1]][best[2]])
                for above in (False, True):
                    path = (*rule, (j, above, limit))
                    rules.setdefault(tuple(sorted(path)), None)
                    grown.append((path, inside & ((x[:, j] > limit) == above)))
            nodes = grown
        for _rule, inside in nodes:
            at = inside & rows
            score[inside] += 0.3 * slope[at].sum() / (curve[at].sum() + 1.0)
    return list(rules)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ensemble:
    """Rules and their weights; with one class or none, a constant."""
    if len(y) == 0:
        return Ensemble((), (), 0.0)
    if y.min() == y.max():
        return Ensemble((), (), 4.0 if y[0] else -4.0)
    rules = grow_rules(x, y)
    seen: dict[bytes, Rule] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        seen.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
    rules = list(seen.values())
    design = np.column_stack([holds(r, x) for r in rules]).astype(np.float64)
    weights, bias = lasso_logistic(design, y.astype(np.float64), penalty)
    kept = [i for i in range(len(rules)) if abs(weights[i]) > 1e-4]
    return Ensemble(tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept), bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held_out: int = 0,
          text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> Ensemble:
    """Fit on labelled rows whose remainder is not ``held_out``. The sample's
    statistics, at most twice ``per_class`` rows, come to the driver."""
    sample = labelled(docs, labels, label, remainder(key, parts) != held_out, per_class, text, key)
    rows = with_statistics(sample.select("k", "y", "text")).toPandas().sort_values(["k", *STATISTICS])
    x, y = rows[list(STATISTICS)].to_numpy(), rows["y"].to_numpy()
    weight = 1.0
    if len(y) and 0 < y.mean() < 1:  # the sample is balanced by its bound only; keep the corpus' share
        share = labels.filter(remainder(key, parts) != held_out).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
        weight = share / (1 - share) * (1 - y.mean()) / y.mean() if 0 < share < 1 else 1.0
    found = fit(x, y)
    return Ensemble(found.rules, found.weights, found.bias + float(np.log(weight)))


def score(docs: DataFrame, model: Ensemble, text: str = "text", key: str = "doc_id", parts: int = 5,
          held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """The key, ``held_out``, ``score``, ``predicted`` and the statistics."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_statistics(rows).withColumn("score", model.column())
    return rows.select(F.col("k").alias(key),
                       F.coalesce(remainder("k", parts) == held_out, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)
