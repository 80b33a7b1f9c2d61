"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become symbols: insult, threat, target, negation, reported
speech, other.  Small transducers rewrite the symbols and are composed into
one machine: negation marks what stands in its scope, reported speech marks
what follows it, a target makes an insult or a threat directed.  The machine
reads clause after clause; what it writes, with the words' own weights, is a
clause's score.  Only matched clauses count, never words by themselves.

The lexicon of insults starts from a short list and learns word stems from
labelled documents, so inflected forms and other languages are covered; the
weights of the machine's outputs are fitted to the same documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from modelkeep.llm import words as W
from modelkeep.llm.common import fold, per_batch, settle, staged
from modelkeep.llm.logistic import regression

# The grammar's words in English, German, French and Spanish.
INSULTS = ("idiot moron stupid loser worthless pathetic disgusting scum trash clown imbecile dumbass "
           "trottel dummkopf abschaum arschloch connard imbécile abruti crétin estúpido imbécil escoria gilipollas").split()
THREATS = ("kill hurt destroy murder strangle töten umbringen verletzen vernichten tuer frapper détruire égorger "
           "matar golpear destruir degollar").split()
TARGETS = ("you your yours he she they them him her his their du dich dein ihr euch sie tu toi vous votre ton ils elles "
           "tú ustedes usted vosotros ellos ellas").split()
NEGATIONS = "not never no isn't aren't don't doesn't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = ("said says told wrote called claims quoted sagte sagt schrieb nannte behauptet dit disait écrit appelé "
           "dijo dice escribió llamó").split()

#: Labelled documents the model is fitted to, about, at most.
SAMPLE = 20_000

#: A learned stem's smallest number of toxic documents, and its smallest log odds.
LEAST_DOCUMENTS, LEAST_ODDS = 4, 3.0
STEM_LENGTHS = range(4, 9)

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")

Arc = tuple[int, str]


@dataclass
class Transducer:
    """Deterministic: (state, symbol) leads to (state, output).  A symbol
    without an arc of its own is written as it is and leads where ``other`` does."""
    arcs: dict[tuple[int, str], Arc]
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs.get((state, symbol)) or (self.other.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """One machine that does what ``second`` makes of the output of ``first``."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for symbol in symbols:
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out)
    return Transducer(arcs)


#: Input symbols.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = SYMBOLS = ["I", "T", "Y", "N", "R", "o"]

#: Insults and threats with their marks: - negated, ~ reported.
MARKED = ["I", "I-", "I~", "I~-", "T", "T-", "T~", "T~-"]

#: Outputs that count, in the order of the features: ! for an insult near after
#: a target, Y with what it follows for a target near after that.
OUTPUTS = [*MARKED, "I!", "I-!", "I~!", "I~-!", *("Y" + x + "!" for x in MARKED)]


def _negation(scope: int = 4) -> Transducer:
    """Insults and threats up to ``scope`` words after a negation are marked -."""
    arcs: dict[tuple[int, str], Arc] = {}
    for state in range(scope + 1):
        arcs[state, NEGATION] = (scope, NEGATION)
        for symbol in (INSULT, THREAT):
            arcs[state, symbol] = (max(0, state - 1), symbol + "-" * (state > 0))
    return Transducer(arcs, {state: max(0, state - 1) for state in range(scope + 1)})


def _reported() -> Transducer:
    """What follows a word of saying in its clause is marked ~."""
    arcs: dict[tuple[int, str], Arc] = {(s, REPORT): (1, REPORT) for s in (0, 1)}
    arcs |= {(1, x): (1, x[0] + "~" + x[1:]) for x in ("I", "I-", "T", "T-")}
    return Transducer(arcs)


def _directed(scope: int = 4) -> Transducer:
    """An insult up to ``scope`` words after a target is marked !; a target up to
    ``scope`` words after an insult or a threat is written with it.  A threat
    is directed only by a target that follows it.  States: nothing (0), or what
    was read last and how many words it still reaches."""
    number = {("", 0): 0}
    for kind in ("Y", *MARKED):
        for left in range(1, scope + 1):
            number[kind, left] = len(number)
    arcs: dict[tuple[int, str], Arc] = {}
    for (kind, _), state in number.items():
        arcs[state, TARGET] = (number["Y", scope], TARGET if kind in ("", "Y") else "Y" + kind + "!")
        for x in MARKED:
            arcs[state, x] = (number["Y", scope], x + "!") if kind == "Y" and x[0] == "I" else (number[x, scope], x)
    return Transducer(arcs, {state: number[kind, left - 1] if left > 1 else 0 for (kind, left), state in number.items()})


MACHINE = compose(compose(_negation(), _reported(), SYMBOLS), _directed(), SYMBOLS)


class Grammar:
    """A lexicon with weights, and the features of texts under the machine."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems  # a stem, or a whole word with "$" after it
        self.symbols = {w: s for ws, s in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)) for w in ws}
        self.lengths = sorted({len(s.rstrip("$")) for s in stems}, reverse=True)
        self.finder = ahocorasick.Automaton()
        for s in [*stems, *THREATS]:
            self.finder.add_word(s.rstrip("$"), len(s.rstrip("$")))
        self.finder.make_automaton()

    def __getstate__(self):
        return self.stems

    def __setstate__(self, stems):
        self.__init__(stems)

    def weight(self, word: str) -> float:
        """Of an insult; 0 for other words."""
        whole = self.stems.get(word + "$")
        if whole is not None:
            return whole
        for n in self.lengths:
            if n <= len(word):
                w = self.stems.get(word[:n])
                if w is not None:
                    return w
        return 0.0

    def clauses(self, low: str):
        """The clauses of a lower-cased text that hold a word of the lexicon."""
        done = 0
        for end, n in self.finder.iter(low):
            start = end - n + 1
            if start < done or start and low[start - 1].isalnum():
                continue
            before = max(low.rfind(c, done, start) for c in ".!?;:\n")
            begin = before + 1 if before >= 0 else done
            after = _CLAUSE_END.search(low, end)
            done = after.start() if after else len(low)
            yield low[begin:done]

    def features(self, text: str) -> np.ndarray:
        """The best clause's score, the sum's logarithm, and how many clauses wrote each output."""
        best, total, counts = 0.0, 0.0, Counter()
        for clause in self.clauses(text.lower()):
            state, score, wrote, last = 0, 0.0, set(), 0.0
            for m in _WORD.finditer(clause):
                word = m[0]
                weight = self.weight(word)
                symbol = INSULT if weight > 0 else self.symbols.get(word, OTHER)
                state, out = MACHINE.arcs[state, symbol]
                if out in COUNTED:
                    score += MODIFY.get(out, 0.0) * (weight if symbol == INSULT else THREAT_WEIGHT if "T" in out else last)
                    wrote.add(out)
                last = weight or last
            best, total = max(best, score), total + max(0.0, score)
            counts.update(wrote)
        return np.array([best, math.log1p(total), *(math.log1p(counts[o]) for o in OUTPUTS)])


#: How an output counts in its clause's score: negated and reported matches are
#: no evidence, directed insults are more, and a threat counts where it is directed.
MODIFY = {"I": 1.0, "I!": 1.4, "YI!": 0.4, "YT!": 1.0}

THREAT_WEIGHT = 4.0
COUNTED = frozenset(OUTPUTS)

#: The weights that labels fit start from, and are drawn to where labels say
#: nothing: the best clause, the sum's logarithm, each output, the constant.
PRIOR = np.array([1.0, 0.5, *np.zeros(len(OUTPUTS)), -2.5])

SEED_WEIGHT = 2.0


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray  # of the features, then the constant

    def score(self, text: str) -> float:
        z = float(self.grammar.features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _stems_of(text: str) -> set[str]:
    found = set()
    for word in set(_WORD.findall(text.lower())):
        found.add(word + "$")
        found.update(word[:n] for n in STEM_LENGTHS if n <= len(word))
    return found


def _sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """(text, toxic): about ``bound`` labelled training documents at most, and
    of those with one signature (near copies, mostly) only the one with the
    smallest id, so that copies don't count as evidence again; staged.

    The sample is taken from the labels, so what is broadcast to the scan of
    the documents is bounded.
    """
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("labelled"), F.col(f"`{label_col}`").cast("double").alias("toxic")).where(
        "labelled is not null and toxic is not null").groupBy("labelled").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    named = staged(named.where(fold(F.col("labelled")) != 0), "labels")
    part = min(1.0, bound / max(1, named.count()))
    few = named.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 20)) < int(part * (1 << 20)))
    signature = arrow_udf(_signature, "long")
    text = F.col(f"`{text_col}`").cast("string")
    met = docs.where(train & text.isNotNull()).join(F.broadcast(few), F.col(f"`{id_col}`").cast("long") == F.col("labelled"))
    met = staged(met.select("labelled", text.alias("text"), "toxic").withColumn("signature", signature("text")), "sample")
    which = F.struct("labelled", F.md5("text"))
    first = met.groupBy("signature").agg(F.min(which).alias("first")).select("first")
    return staged(met.join(first, which == F.col("first"), "left_semi").dropDuplicates(["labelled", "signature"]).select("text", "toxic"), "sample-once")


def _signature(text: pa.Array) -> pa.Array:
    """The smallest hash of five words in a row: near copies mostly share it."""
    out = []
    for _, _, data, bounds in W.slices(text):
        begin, end, first = W.spans(W.LOWER[data], bounds, W.LETTERS)
        h = W.hashes(W.LOWER[data], begin, end)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            runs = W.windows(h[a:b], min(5, b - a)) if b > a else np.zeros(1, np.uint64)
            out.append(int(runs.min().view(np.int64)))
    return pa.array(out, pa.int64())


def _learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems whose documents are nearly all toxic; each accepted stem must be
    common, or explain documents that no stem accepted before it explains."""
    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(_stems_of(text))
        yield pa.record_batch([pa.array(list(toxic), pa.string()), pa.array(list(toxic.values()), pa.int64()),
                               pa.array([clean[s] for s in toxic], pa.int64())], names=["stem", "toxic", "clean"])
        rest = [s for s in clean if s not in toxic]
        yield pa.record_batch([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([clean[s] for s in rest], pa.int64())],
                              names=["stem", "toxic", "clean"])
    totals = dict(sample.groupBy("toxic").count().collect())
    t, n = totals.get(1, 0), totals.get(0, 0)
    if not t or not n:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (n + 1))
    found = sample.mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn(
        "odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    seen = {r["stem"]: (r["toxic"], r["odds"]) for r in found}
    # Of stems that stand in the same documents the longest says most.
    longer: dict[str, int] = {}
    for s, (k, _) in seen.items():
        for m in range(STEM_LENGTHS.start, len(s)):
            longer[s[:m]] = max(longer.get(s[:m], 0), k)
    candidates = {s: v for s, v in seen.items() if longer.get(s, 0) < v[0] and not (s.endswith("$") and seen.get(s[:-1], (0,))[0] > v[0])}
    if not candidates:
        return {}

    def members(batch):
        rows = [[s for s in own if s in candidates] for own in map(_stems_of, batch.column(0).to_pylist()) if not own & chosen.keys()]
        return pa.record_batch([pa.array(rows, pa.list_(pa.string()))], names=["stems"])
    seeds = {w + "$" for w in INSULTS}
    chosen = {s: v[1] for s, v in seen.items() if s in seeds}
    documents = [set(r[0]) for r in sample.where("toxic = 1").mapInArrow(per_batch(members), "stems array<string>").collect()]
    left = Counter(s for d in documents for s in d)
    while left:
        stem, k = max(left.items(), key=lambda x: (x[1], candidates[x[0]][0], len(x[0]), x[0]))
        del left[stem]
        if any(stem.startswith(c) for c in chosen if not c.endswith("$")):
            continue
        if k >= LEAST_DOCUMENTS or candidates[stem][0] >= 5 * LEAST_DOCUMENTS and candidates[stem][0] >= 0.02 * t:
            chosen[stem] = candidates[stem][1]
            for d in documents:
                if stem in d:
                    for other in d:
                        if other in left:
                            left[other] -= 1
                    d.clear()
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        bound: int = SAMPLE) -> Model:
    """A model from labelled documents for which ``train`` holds.

    Labels of one id are averaged; null labels, ids and texts take no part.
    Without both kinds of labels the fixed lexicon and its weights serve.
    """
    settle(docs.sparkSession)
    sample = _sample(docs, labels, train, id_col, text_col, label_col, bound)
    stems = {w + "$": SEED_WEIGHT for w in INSULTS} | _learn_stems(sample)
    grammar = Grammar(stems)

    def run(batch):
        rows = [grammar.features(t).tolist() for t in batch.column(0).to_pylist()]
        return pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])
    # At most ``bound`` rows of a few numbers.
    rows = sample.mapInArrow(per_batch(run), "x array<double>, y int").toArrow()
    y = rows["y"].to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    if not (0 < y.sum() < len(y)):
        return Model(grammar, PRIOR)
    x = np.array(rows["x"].to_pylist())
    return Model(grammar, regression(x, y, center=PRIOR))


def score_column(spark, model: Model):
    """A function of a text column: its score (null: as empty)."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([own.score(t or "") for t in text.to_pylist()], pa.float64())
    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``.

    Null and empty texts get the score of a text without matches; ids may be
    null or repeated; an empty table gives no rows; other columns aren't read.
    """
    settle(docs.sparkSession)
    score = score_column(docs.sparkSession, model)
    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_rows(id_col: str = "doc_id") -> Column:
    """crc32(id) mod 5 is not 0."""
    return fold(F.col(f"`{id_col}`")) > 0


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; those with crc32(doc_id) mod 5 = 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training_rows())
    done = toxicity(docs, model)
    return done.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
