"""Language identification with spans of mixed-language texts.

A word is a run of letters of one script.  The script ranges narrow its
candidates to the languages that are written in it, which is learned from
labelled texts.  Each candidate scores the word by its character trigrams,
word borders included: the logarithm of their share in the language's texts
against their mean share in all languages, mixed with a little of that mean so
that one unseen trigram is bounded evidence.  Viterbi over the words' scores,
with a penalty for every switch of language, labels the words, and words in a
row with one label are a span.  A text's language is that of most of its
letters.

Trigrams are counted in hashed buckets over all labelled texts, with partial
aggregation; what a model holds doesn't grow with the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import fold, per_batch, settle, staged

#: Code point ranges of scripts, the last code point included.
SCRIPT_RANGES = {
    "Latin": [(0x0041, 0x024F), (0x0250, 0x02AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x0530, 0x058F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Oriya": [(0x0B00, 0x0B7F)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Sinhala": [(0x0D80, 0x0DFF)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Lao": [(0x0E80, 0x0EFF)],
    "Tibetan": [(0x0F00, 0x0FFF)],
    "Myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "Khmer": [(0x1780, 0x17FF), (0x19E0, 0x19FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

#: A character's script: 0 no word character, 1 a mark of whatever goes before, 2 a letter of none of these scripts.
_MARK, _OTHER = 1, 2
SCRIPTS = len(SCRIPT_RANGES) + 3

#: A language is written in a script if at least this share of its letters is.
SCRIPT_SHARE = 0.001

#: Share of the mean over all languages in a trigram's probability.
BACKGROUND = 0.01

#: Cost of a switch of language, in natural logarithms of likelihood.
SWITCH = 12.0

#: Size of a model's table; buckets are halved until it fits.
BUCKETS, MODEL_BYTES = 1 << 18, 1 << 26

#: Languages of a model at most (more are an error, none is left out).
LANGUAGES = 4096

_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its script, its lower case, and whether it is a letter."""
    if not _TABLES:
        script, small = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for c in [*range(0x323B0), *range(0xE0100, 0xE01F0)]:
            own = chr(c)
            kind = unicodedata.category(own)[0]
            if kind in "LM":
                script[c], letter[c] = _OTHER if kind == "L" else _MARK, kind == "L"
                low = own.lower()
                if len(low) == 1:
                    small[c] = ord(low)
        for k, ranges in enumerate(SCRIPT_RANGES.values(), 3):
            for lo, hi in ranges:
                script[lo:hi + 1][script[lo:hi + 1] > 0] = k
        _TABLES.extend((script, small, letter))
    return tuple(_TABLES)


class Words:
    """The words of some texts: characters in lower case, each word's begin,
    end, script and letters, and the first word of each text."""

    def __init__(self, texts: list[str]):
        script, small, letter = tables()
        lengths = np.array([len(t) for t in texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = script[points]
        # A mark belongs to the letter before it; one that no letter precedes is none.
        known = of != _MARK
        known[self.bounds[:-1][lengths > 0]] = True
        of = np.where(of == _MARK, 0, of)[np.maximum.accumulate(np.where(known, np.arange(len(of)), 0))] if len(of) else of
        inside = of > 0
        new = inside.copy()
        new[1:] &= of[1:] != of[:-1]
        start = self.bounds[:-1][self.bounds[:-1] < len(of)]
        new[start] = inside[start]
        after = np.zeros(len(of) + 1, bool)
        after[1:] = inside
        after[1:-1] &= ~inside[1:] | new[1:]
        self.begin, self.end = np.flatnonzero(new), np.flatnonzero(after)
        self.script = of[self.begin]
        self.points = small[points]
        letters = np.concatenate([[0], np.cumsum(letter[points])])
        self.letters = letters[self.end] - letters[self.begin]
        self.first = np.searchsorted(self.begin, self.bounds)

    def grams(self, lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the trigrams of words ``lo`` to ``hi``, borders included, and where each word's begin."""
        begin, n = self.begin[lo:hi], self.end[lo:hi] - self.begin[lo:hi]
        first = np.cumsum(n + 1) - (n + 1)
        word = np.repeat(np.arange(hi - lo), n + 1)
        at = np.arange(len(word)) - first[word]  # the place that the trigram ends at; its word's length: the border
        padded = np.zeros(len(word), np.uint64)
        padded[at < n[word]] = self.points[(begin[word] + at)[at < n[word]]]
        one = np.zeros_like(padded)
        one[1:] = padded[:-1]
        one[at < 1] = 0
        two = np.zeros_like(padded)
        two[2:] = padded[:-2]
        two[at < 2] = 0
        return (W.mix(padded | one << np.uint64(21) | two << np.uint64(42)) >> np.uint64(64 - bits)).astype(np.int64), first


def _words(column: pa.Array, limit: int) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, bounds in W.slices(column, limit):
        raw = data.tobytes()
        yield lo, hi, Words([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])


# ---------------------------------------------------------------------- model
class Model:
    """Languages, their script candidates, trigram scores and shares of the texts."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray, texts: np.ndarray):
        """``counts``: buckets x languages; ``letters``: scripts x languages; ``texts`` of each language."""
        self.languages, self.bits = languages, max(1, int(np.log2(max(2, len(counts)))))
        share = counts / np.maximum(counts.sum(axis=0), 1)
        mean = share.mean(axis=1, keepdims=True) if languages else np.zeros((len(counts), 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.scores = np.where(mean > 0, np.log((1 - BACKGROUND) * share / mean + BACKGROUND), 0.0).astype(np.float32)
        used = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
        self.candidates = used | ~used.any(axis=1, keepdims=True)
        self.start = np.log((texts + 1) / (texts.sum() + len(texts))) if languages else np.zeros(0)

    def word_scores(self, words: Words) -> np.ndarray:
        """words x languages; languages that a word's script rules out get -1e6."""
        out = np.zeros((len(words.begin), len(self.languages)), np.float32)
        size = words.end - words.begin + 1
        chunk = max(1, (1 << 22) // max(1, len(self.languages)))
        cuts = np.searchsorted(np.cumsum(size), np.arange(chunk, int(size.sum()) + chunk, chunk), "right")
        lo = 0
        for hi in [*cuts.tolist(), len(size)]:
            hi = max(hi, lo + 1) if lo < len(size) else lo
            if hi > lo:
                bucket, first = words.grams(lo, hi, self.bits)
                out[lo:hi] = np.add.reduceat(self.scores[bucket], first, axis=0)
                lo = hi
        out[~self.candidates[words.script]] = -1e6
        return out


def learn(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of ``docs`` where ``training`` holds (null: not)
    and the language isn't null."""
    spark = docs.sparkSession
    own = docs.where(F.coalesce(training, F.lit(False)) & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(texts) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values; it isn't a language.")
    buckets = BUCKETS
    while buckets * 4 * len(texts) > MODEL_BYTES:
        buckets //= 2
    bits = buckets.bit_length() - 1
    languages = [r["lang"] for r in texts]

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, words in _words(batch.column(1), W.SLICE_BYTES):
                named = np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object)
                bucket, first = words.grams(0, len(words.begin), bits)
                text_of_word = np.repeat(np.arange(hi - lo), np.diff(words.first))
                text_of_gram = np.repeat(text_of_word, words.end - words.begin + 1)
                for lang in set(named.tolist()):
                    mine = named == lang
                    have = total.setdefault(lang, np.zeros(buckets + SCRIPTS, np.int64))
                    have[:buckets] += np.bincount(bucket[mine[text_of_gram]], minlength=buckets)
                    words_of = mine[text_of_word]
                    have[buckets:] += np.bincount(words.script[words_of], weights=words.letters[words_of], minlength=SCRIPTS).astype(np.int64)
            if len(total) > 16:
                yield from _rows(total)
                total = {}
        yield from _rows(total)
    counted = own.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = staged(counted, "trigrams").toArrow()  # at most languages x (buckets + SCRIPTS) rows
    place = {lang: k for k, lang in enumerate(languages)}
    full = np.zeros((buckets + SCRIPTS, len(languages)))
    full[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return Model(languages, full[:buckets], full[buckets:], np.array([r["n"] for r in texts], float))


def _rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some])], names=["lang", "bucket", "n"])


# -------------------------------------------------------------------- Viterbi
def viterbi(scores: np.ndarray, best: np.ndarray, run_end: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of words with ``scores`` (words x labels), a switch
    costing ``penalty``.

    ``best`` is each word's best label and ``run_end`` the end of the words in a
    row with that.  Once every other label is worth less than a switch from the
    leading one, words that this one scores best change nothing of that; they
    are passed over together.
    """
    n = len(scores)
    now = (start + scores[0]).tolist()
    back: list[tuple[int, int, int, list[bool] | None]] = []
    t = 1
    while t < n:
        most = max(now)
        lead, floor = now.index(most), most - penalty
        stay = [x > floor for x in now]
        if best[t] == lead and sum(stay) == 1:
            end = int(run_end[t])
            back.append((t, end, lead, None))
            now = [x - penalty for x in scores[end - 1].tolist()]
            now[lead] += penalty
            t = end
        else:
            back.append((t, t + 1, lead, stay))
            now = [(x if s else floor) + y for x, s, y in zip(now, stay, scores[t].tolist())]
            t += 1
    label = now.index(max(now))
    labels = np.empty(n, np.int64)
    for a, z, lead, stay in reversed(back):
        labels[z - 1] = label
        if stay is None:
            labels[a:z - 1] = lead
            label = lead
        elif not stay[label]:
            label = lead
    labels[0] = label
    return labels


def label(texts: Words, model: Model, penalty: float) -> np.ndarray:
    """The label of each word."""
    scores = model.word_scores(texts)
    best = scores.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
    labels = np.zeros(len(scores), np.int64)
    cut = np.ones(len(best) + 1, bool)
    cut[1:-1] = best[1:] != best[:-1]
    cut[texts.first] = True
    ends = np.flatnonzero(cut)
    run_end = ends[np.searchsorted(ends, np.arange(len(best)), "right")]
    for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist()):
        if b > a:
            labels[a:b] = viterbi(scores[a:b], best[a:b].tolist(), run_end[a:b] - a, model.start, penalty)
    return labels


_FOUND = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (the share
    of its letters in words of that language) and spans (begin and end in
    characters, end exclusive, and language of each run of words with one label).

    Null texts, and texts without a letter, are ``und`` with score 0 and no
    spans, as all texts are where the model knows no language.  Equal shares
    go to the language that sorts first.  Ids may be null or repeated; an empty
    table gives no rows.
    """
    settle(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        own = shared.value
        k = len(own.languages)
        for lo, hi, words in _words(batch.column(1), max(1 << 14, min(W.SLICE_BYTES, (1 << 22) // max(1, k)))):
            n = hi - lo
            text = np.repeat(np.arange(n), np.diff(words.first))
            labels = label(words, own, penalty) if k else np.zeros(len(text), np.int64)
            letters = np.bincount(text * max(k, 1) + labels, weights=words.letters, minlength=n * max(k, 1)).reshape(n, max(k, 1))
            total, top = letters.sum(axis=1), letters.argmax(axis=1)
            known = (total > 0) & (k > 0)
            score = np.where(known, letters[np.arange(n), top] / np.maximum(total, 1), 0.0)
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])
            head = np.flatnonzero(new & known[text])
            tail = np.flatnonzero(np.append(new[1:], True) & known[text]) if len(text) else head
            shift = words.bounds[text[head]]
            names = np.array(own.languages or [""], object)
            spans = pa.StructArray.from_arrays([pa.array(words.begin[head] - shift, pa.int32()), pa.array(words.end[tail] - shift, pa.int32()),
                                                pa.array(names[labels[head]].tolist(), pa.string())], fields=list(_SPANS.value_type))
            cuts = np.searchsorted(text[head], np.arange(n + 1))
            yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(np.where(known, names[top], "und").tolist(), pa.string()), pa.array(score),
                                   pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)], names=["doc_id", "lang_pred", "score", "spans"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(per_batch(run), f"doc_id long, {_FOUND}")


def op11_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language; those with crc32(doc_id) mod 4 = 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, fold(F.col("doc_id"), 4) != 2)
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
