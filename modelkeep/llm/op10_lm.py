"""Language-model scores of texts: the marginal likelihood of a subword lattice.

A word is spelled by the pieces of an existing vocabulary in many ways.  Its
lattice has an arc for every piece that stands at some place of it (any byte
has a fallback piece), and the forward recursion, in log space, sums over all
paths: the marginal probability of the word, whichever way it is cut.  Arc
weights start from the vocabulary's own scores.  One round of expected counts
over the words of the training texts (forward and backward) fits these weights to
the corpus, with the file's scores as the prior; pieces stay as they are.

A text's score is its marginal probability in the lattice, the sum over its
words and its end.  Beside it stands a mixture with the corpus: a token's count
c is discounted by D, and the mass so freed goes to the lattice:
(max(c - D, 0) + D V lattice(word)) / N, with N tokens and V distinct ones in
training.

Tokens are counted over all texts with partial aggregation.  To score, the
commonest tokens (at most ``HEAD``, whatever the corpus) are broadcast and
summed where the text is; the others, none of which is common, meet their
probabilities in a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import apart, fold, id_and_text, per_batch, settle, staged

#: Tokens that are broadcast: about 20 MB, whatever the corpus.
HEAD = 1 << 19

#: The token at the end of each text; it can't be a word.
END = "\n"

#: Words of more bytes go through the lattice one by one.
LONG = 96

#: Weight of the file's scores against the expected counts, as a share of the words.
PRIOR = 0.02


class Lattice:
    """Pieces with log weights, and sums over all segmentations.

    ``pieces`` are byte strings; index len(pieces) + b is the fallback of the
    byte b, and the last index the end of the word.
    """

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray):
        self.pieces, self.log_weights = pieces, log_weights
        n = len(pieces)
        self.fallback, self.stop = n, n + 256
        self.index = {p: k for k, p in enumerate(pieces)}
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(k)
        self.tables = []
        for length, own in sorted(by_length.items()):
            data = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8)
            at = np.arange(len(own)) * length
            h = W.hashes(data, at, at + length)
            order = np.argsort(h)
            self.tables.append((length, h[order], np.array(own)[order], data.reshape(-1, length)[order]))
        self.longest = max(by_length, default=1)

    @classmethod
    def from_model(cls, model: bytes) -> Lattice:
        """The pieces of a sentencepiece model.  Scores of a unigram model are
        log probabilities; those of a merge list are minus the rank, and weigh
        as 1 / rank."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, scores = [], []
        for k in range(sp.get_piece_size()):
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
                pieces.append(sp.id_to_piece(k).encode())
                scores.append(sp.get_score(k))
        scores = np.array(scores)
        ranks = len(scores) and np.all(scores == np.round(scores)) and scores.min() <= 1 - len(scores)
        log_weights = -np.log(10 - scores) if ranks else scores
        # Fallback bytes and the end of the word take the place of rare and of common pieces.
        log_weights = np.concatenate([log_weights, np.full(256, log_weights.min() if len(scores) else 0.0), [log_weights.max() if len(scores) else 0.0]])
        return cls(pieces, log_weights - np.log(np.exp(log_weights).sum()))

    def arcs(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begin, end and piece of all arcs in the words of ``data``."""
        n = len(data)
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # bytes to the word's end
        places = np.arange(n)
        begin, end, piece = [places], [places + 1], [self.fallback + data.astype(np.int64)]
        for length, table, own, spelled in self.tables:
            at = places[left >= length] if length > 1 else places
            if not len(at):
                break
            h = W.hashes(data, at, at + length)
            k = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = np.flatnonzero(table[k] == h)
            hit = hit[(np.lib.stride_tricks.sliding_window_view(data, length)[at[hit]] == spelled[k[hit]]).all(axis=1)]
            begin.append(at[hit])
            end.append(at[hit] + length)
            piece.append(own[k[hit]])
        return np.concatenate(begin), np.concatenate(end), np.concatenate(piece)

    @staticmethod
    def _waves(arcs_from: np.ndarray, arcs_to: np.ndarray, weights: np.ndarray, depth: np.ndarray, value: np.ndarray) -> None:
        """value[to] = log sum over arcs of exp(value[from] + weight), by growing depth of ``to``."""
        order = np.lexsort((arcs_to, depth))
        a, b, w, d = arcs_from[order], arcs_to[order], weights[order], depth[order]
        cuts = np.flatnonzero(np.diff(d)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(d)]])):
            to = b[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            v = value[a[lo:hi]] + w[lo:hi]
            most = np.maximum.reduceat(v, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, hi - lo)))
            value[to[heads]] = most + np.log(np.add.reduceat(np.exp(v - most[group]), heads))

    def forward(self, data: np.ndarray, bounds: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each word; ``expected`` gets its pieces' expected counts added.

        Positions of a word of n bytes are n + 1 nodes.
        """
        n_words = len(bounds) - 1
        total = np.full(n_words, self.log_weights[self.stop])
        if expected is not None:
            expected[self.stop] += n_words
        if not len(data):
            return total
        lengths = np.diff(bounds)
        word = np.repeat(np.arange(n_words), lengths)
        begin, end, piece = self.arcs(data, bounds)
        own = word[begin]
        node_from, node_to = begin + own, end + own  # each word has one node more than bytes
        first = bounds[:-1] + np.arange(n_words)
        last = bounds[1:] + np.arange(n_words)
        w = self.log_weights[piece]
        alpha = np.zeros(len(data) + n_words)
        self._waves(node_from, node_to, w, node_to - first[own], alpha)
        total = alpha[last] + self.log_weights[self.stop]
        if expected is not None:
            beta = np.full(len(alpha), self.log_weights[self.stop])
            self._waves(node_to, node_from, w, last[own] - node_from, beta)
            np.add.at(expected, piece, np.exp(alpha[node_from] + w + beta[node_to] - total[own]))
        return total

    def forward_long(self, word: bytes, expected: np.ndarray | None = None) -> float:
        """The same for one word of any length, node by node."""
        n, index, w = len(word), self.index, self.log_weights

        def arcs(at):
            yield at + 1, self.fallback + word[at]
            for k in range(1, min(self.longest, n - at) + 1):
                p = index.get(word[at:at + k])
                if p is not None:
                    yield at + k, p
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for at in range(n):
            for to, p in arcs(at):
                x, y = alpha[to], alpha[at] + w[p]
                hi, lo = (x, y) if x > y else (y, x)
                alpha[to] = hi + math.log1p(math.exp(lo - hi))
        total = alpha[n] + w[self.stop]
        if expected is not None:
            beta = [-math.inf] * n + [float(w[self.stop])]
            for at in range(n - 1, -1, -1):
                for to, p in arcs(at):
                    x, y = beta[at], beta[to] + w[p]
                    hi, lo = (x, y) if x > y else (y, x)
                    beta[at] = hi + math.log1p(math.exp(lo - hi))
                for to, p in arcs(at):
                    expected[p] += math.exp(alpha[at] + w[p] + beta[to] - total)
            expected[self.stop] += 1
        return float(total)

    def log_probabilities(self, words: pa.Array, expected: np.ndarray | None = None) -> np.ndarray:
        """Of each word (the end token: of an empty word), natural logarithms."""
        marked = pc.if_else(pc.equal(words, END), "", pc.binary_join_element_wise("▁", words, ""))
        out = np.empty(len(words))
        for lo, hi, data, bounds in W.slices(marked, 1 << 19):
            lengths = np.diff(bounds)
            short = lengths <= LONG
            keep = np.repeat(short, lengths)
            own = data[keep]
            cut = np.concatenate([[0], np.cumsum(lengths[short])])
            part = np.empty(hi - lo)
            part[short] = self.forward(own, cut, expected)
            for k in np.flatnonzero(~short):
                part[k] = self.forward_long(data[bounds[k]:bounds[k + 1]].tobytes(), expected)
            out[lo:hi] = part
        return out


def _unique_words(data, bounds, training):
    """Distinct words of a slice with their counts in all and in training texts."""
    data = W.LOWER[data]
    begin, end, first = W.spans(data, bounds, W.NOT_SPACE)
    h, check = (W.hashes(data, begin, end, k) for k in (0, 1))
    own, at, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    in_training = np.bincount(of, weights=np.repeat(training, np.diff(first)), minlength=len(own)).astype(np.int64)
    raw = data.tobytes()
    if not np.array_equal(check, check[at][of]):  # two words with one hash
        counts: dict[bytes, list[int]] = {}
        for b, e, t in zip(begin.tolist(), end.tolist(), np.repeat(training, np.diff(first)).tolist()):
            c = counts.setdefault(raw[b:e], [0, 0])
            c[0] += 1
            c[1] += int(t)
        return [w.decode() for w in counts], [c[0] for c in counts.values()], [c[1] for c in counts.values()]
    return [raw[b:e].decode() for b, e in zip(begin[at].tolist(), end[at].tolist())], n, in_training


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n, c): counts in all and in training rows of ``docs`` (training, text)."""
    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            training = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, n, c = _unique_words(data, bounds, training)
            yield pa.record_batch([pa.array([*tokens, END], pa.string()), pa.array([*n, hi - lo], pa.int64()), pa.array([*c, int(training.sum())], pa.int64())],
                                  names=["token", "n", "c"])
    return docs.select("training", "text").mapInArrow(per_batch(run), "token string, n long, c long").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"))


def adapted(lattice: Lattice, vocabulary: DataFrame, rounds: int = 1) -> Lattice:
    """``lattice`` with weights from expected counts over the training words of
    ``vocabulary`` (token, c), each word once, and its own weights as prior."""
    prior = np.exp(lattice.log_weights)
    for _ in range(rounds):
        shared = vocabulary.sparkSession.sparkContext.broadcast((lattice.pieces, lattice.log_weights))

        def run(batches, shared=shared):
            own = Lattice(*shared.value)
            expected = np.zeros(len(own.log_weights))
            for batch in batches:
                if batch.num_rows:
                    own.log_probabilities(batch.column(0), expected)
            k = np.flatnonzero(expected)
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(expected[k])], names=["piece", "expected"])
        sums = vocabulary.where("c > 0").select("token").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(
            F.sum("expected").alias("expected")).toArrow()
        expected = np.zeros(len(prior))
        expected[sums["piece"].to_numpy()] = sums["expected"].to_numpy()
        expected += prior * (1.0 + PRIOR * expected.sum())
        lattice = Lattice(lattice.pieces, np.log(expected / expected.sum()))
    return lattice


def token_scores(vocabulary: DataFrame, lattice: Lattice, tokens: int, distinct: int, discount: float) -> DataFrame:
    """(token, n, c, base, score, mixed): log10 probabilities of each token of ``vocabulary`` (token, n, c)."""
    shared = vocabulary.sparkSession.sparkContext.broadcast((lattice.pieces, lattice.log_weights))
    floor = math.log10(tokens + 0.5 * (distinct + 1))

    def run(batches):
        own = Lattice(*shared.value)
        for batch in batches:
            if batch.num_rows:
                c = batch.column(2).to_numpy().astype(float)
                spelled = mixed = own.log_probabilities(batch.column(0)) / math.log(10)
                if tokens:
                    freed = spelled + math.log10(discount * distinct / tokens)
                    seen = np.log10(np.maximum(c - discount, 1e-300) / tokens)
                    high, low = np.maximum(freed, seen), np.minimum(freed, seen)
                    mixed = high + np.log1p(10.0 ** np.maximum(low - high, -300.0)) / math.log(10)
                yield pa.record_batch([*batch.columns, pa.array(np.log10(c + 0.5) - floor), pa.array(spelled), pa.array(mixed)],
                                      names=["token", "n", "c", "base", "score", "mixed"])
    return vocabulary.select("token", "n", "c").mapInArrow(run, "token string, n long, c long, base double, score double, mixed double")


def _head(scored: DataFrame) -> tuple[np.ndarray, ...]:
    """Hashes and scores of the commonest tokens: the largest set of at most
    ``HEAD`` that a count's power of 2 to the 1/8 bounds."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, left = None, HEAD
    for bucket, n in sorted(scored.groupBy(step.alias("s")).count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = bucket

    def run(batch):
        data, bounds = W.texts(batch.column(0))
        return pa.record_batch([pa.array(W.hashes(data[bounds[0]:bounds[-1]], bounds[:-1] - bounds[0], bounds[1:] - bounds[0], k)) for k in (0, 1)]
                               + [pc.greater(batch.column(1), 0), *batch.columns[2:]], names=["h", "check", "known", "base", "score", "mixed"])
    head = scored.where(F.lit(False) if least is None else step >= least).select("token", "c", "base", "score", "mixed").mapInArrow(
        per_batch(lambda b: _unsigned(run(b))), "h long, check long, known boolean, base double, score double, mixed double").toArrow()
    h = head["h"].to_numpy().view(np.uint64) if head.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(h)
    rest = [np.asarray(head[c].to_numpy(), t)[order] for c, t in (("check", np.int64), ("known", bool), ("base", float), ("score", float), ("mixed", float))]
    return h[order], *rest


def _unsigned(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch([pa.array(batch.column(k).to_numpy().view(np.int64)) for k in (0, 1)] + batch.columns[2:], names=batch.schema.names)


def scores(docs: DataFrame, model: bytes, training: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_known,
    train_tokens, base_score (additive smoothing of the counts), score (the
    lattice's) and mixed_score (counts mixed with the lattice).

    ``model`` is a sentencepiece model's content, ``training`` a condition on
    the columns of ``docs`` (null: not).  Null is an empty text, with one
    token, its end.  Ids may be null or repeated.  Without training texts
    every token is scored by the lattice alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    own = id_and_text(docs, id_col, text_col)
    flagged = docs.select(F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    vocabulary = staged(token_counts(flagged), "vocabulary")
    tokens, distinct, once, twice = (int(x or 0) for x in vocabulary.agg(
        F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    lattice = adapted(Lattice.from_model(model), vocabulary, rounds) if tokens else Lattice.from_model(model)
    scored = staged(token_scores(vocabulary, lattice, tokens, distinct, discount), "token-scores")
    head = spark.sparkContext.broadcast(_head(scored))
    end = scored.where(F.col("token") == END).select("c", "base", "score", "mixed").first()
    end = tuple(end) if end else (0, 0.0, 0.0, 0.0)

    def run(batch):
        table, table_check, known, base, score, mixed = head.value
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            data = W.LOWER[data]
            begin, after, first = W.spans(data, bounds, W.NOT_SPACE)
            h, check = (W.hashes(data, begin, after, k) for k in (0, 1))
            doc, n = np.repeat(np.arange(hi - lo), np.diff(first)), hi - lo
            k = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
            hit = (table[k] == h) & (table_check[k] == check.view(np.int64)) if len(table) else np.zeros(len(h), bool)
            sums = [np.bincount(doc[hit], weights=x[k[hit]], minlength=n) for x in (known, base, score, mixed)] if hit.any() else [np.zeros(n)] * 4
            raw, rare = data.tobytes(), np.flatnonzero(~hit)
            flat = pa.array([raw[b:e] for b, e in zip(begin[rare].tolist(), after[rare].tolist())], pa.binary()).cast(pa.string())
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))])
            yield pa.record_batch([
                batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first) + 1, pa.int64()), pa.array(sums[0].astype(np.int64) + (end[0] > 0), pa.int64()),
                pa.array(sums[1] + end[1]), pa.array(sums[2] + end[2]), pa.array(sums[3] + end[3]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)],
                names=["doc_id", "n_tokens", "n_known", "base", "score", "mixed", "rare"])
    summed = staged(own.mapInArrow(per_batch(run), "doc_id long, n_tokens long, n_known long, base double, score double, mixed double, rare array<string>").withColumn(
        "row", F.monotonically_increasing_id()), "summed")
    rare = summed.select("row", F.explode("rare").alias("word"))
    met = rare.join(scored.select("token", "c", F.col("base").alias("b"), F.col("score").alias("s"), F.col("mixed").alias("x")), F.col("word") == F.col("token"))
    rest = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("x").alias("x"))
    rest = rest.select(apart(F.col("row")).alias("of"), "k", "b", "s", "x")
    joined = summed.drop("rare").join(rest, F.col("row") == F.col("of"), "left")
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                         (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
                         (F.col("mixed") + F.coalesce("x", F.lit(0.0))).alias("mixed_score"))


def op10_lm(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's scores; those with crc32(doc_id) mod 5 = 1 are held out."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = scores(docs, model, fold(F.col("doc_id")) != 1)
    return done.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")


def op10_corpus_lm(spark, sf_dir: str) -> DataFrame:
    """The registered query: ``score`` sums over all paths of the lattice that also
    has an arc for each word of the training texts.

    A word's own arc weighs max(c - D, 0) / N, the way to its spellings D V / N; the
    sum over both is ``mixed_score``.  ``lattice_score`` has the spellings alone,
    which pay for frequent words several pieces each.
    """
    done = op10_lm(spark, sf_dir)
    return done.withColumnsRenamed({"score": "lattice_score"}).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), "lattice_score", "mixed_score")


#: DuckDB has no lattice: tests check the columns by brute force.
