"""Language identification: script ranges narrow the candidates of each word, per-word scores come from
character n-grams, and a Viterbi pass with a penalty for switching labels spans of mixed-language text.

The model is fitted on a bounded sample: about SAMPLE documents a language, chosen by a hash of id and
text.  Its counts are hashed into BUCKETS numbers a language, and a language needs a share of RARE of the documents
whose language is known, so that the model is bounded whatever the corpus and however dirty its labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import text_pass

#: Expected documents of each language that the model is fitted on.
SAMPLE = 1_500
#: The least share of documents of known language that a language must have to be learned: 1,000 languages at most.
RARE = 0.001
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.05
#: What a change of language costs, in nats.
SWITCH = 9.0
#: Share of a language's training letters that makes a script one of its own.
OWN_SCRIPT = 0.01
#: Share of a text's letters that makes a language one of its main ones; the text is named after the first of these.
MAIN = 0.25
UNKNOWN = "und"
#: Words of a text that are labelled side by side, and places of such blocks that are held at once.
BLOCK = 256
PLACES = 1 << 17

#: First code points of script ranges (Unicode blocks), and the script from there on.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Han"), (0x40000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES], np.int64)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.int64)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def split(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, each word's number among them, and where each text's words begin (and the last end)."""
    lower = pc.utf8_lower(pa.array(texts, pa.string()).fill_null(""))
    words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\pL\pM]+", " "), " "), " ")
    flat = words.flatten().dictionary_encode()
    ends = words.offsets.to_numpy().astype(np.int64)
    kinds, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
    # a text without a letter gives one empty word, and marks may stand without a letter
    real = np.array([any(c.isalpha() for c in w) for w in kinds], bool)
    if real.all():
        return kinds, codes, ends - ends[0]
    kept = real[codes]
    behind = np.concatenate(([0], np.cumsum(kept)))
    number = np.cumsum(real) - 1
    return [w for w, r in zip(kinds, real) if r], number[codes[kept]], behind[ends - ends[0]]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of words with edge marks: each one's bucket and word."""
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = np.cumsum(points == 2) - 1
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            same = number[: len(h)] == number[n - 1 :]
            mixed = h[same] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append(((mixed ^ mixed >> np.uint64(29)) >> np.uint64(13)).astype(np.int64) % BUCKETS)
            owners.append(number[: len(h)][same])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def script_of(words: list[str]) -> np.ndarray:
    """The script number of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT[np.searchsorted(_STARTS, first, "right") - 1]


class Model:
    """Languages, their priors, hashed n-gram log-probabilities, and the scripts that each is written in."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        self.prior = np.log((documents + 1) / (documents + 1).sum()) if languages else np.zeros(0)
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32)
        self.scripts = letters > OWN_SCRIPT * np.maximum(letters.sum(axis=1, keepdims=True), 1)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability ratio of each word in each language to the best; languages of other scripts are out of the question,
        and a word in no language's script says nothing."""
        n = len(words)
        if not n:
            return np.zeros((0, len(self.languages)), np.float32)
        buckets, owners = grams(words)
        out = np.stack([np.bincount(owners, self.logs[buckets, k], n) for k in range(len(self.languages))], axis=1)
        # n-grams of all orders overlap: their sum counts each character about once for each order
        out /= len(ORDERS) / 2
        fits = self.scripts.T[script_of(words)]
        out = np.where(fits, out, -np.inf)
        best = out.max(axis=1, keepdims=True)
        known = np.isfinite(best)
        return np.where(known, np.maximum(out - np.where(known, best, 0.0), -30.0), 0.0).astype(np.float32)

    def labels(self, scored: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The language number of each word on each text's best path.

        Texts are cut into blocks of BLOCK words; blocks of like size are solved side by side, for every language
        before them, PLACES at a time; blocks are then joined along their texts, and paths are traced back.
        """
        states = len(self.languages)
        n = np.diff(ends)
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(n)), blocks)
        first = np.concatenate(([0], np.cumsum(blocks)))
        begin = ends[owner] + (np.arange(first[-1]) - first[owner]) * BLOCK
        size = np.minimum(BLOCK, ends[owner + 1] - begin)
        count = len(begin)
        if not count:
            return np.zeros(0, np.int64)
        value, solved = np.empty((count, states, states)), []
        by_size, a = np.argsort(-size, kind="stable"), 0
        while a < count:
            here = by_size[a : a + max(1, PLACES // int(size[by_size[a]]))]
            value[here], turned, source = self._solved(scored, begin[here], size[here])
            solved.append((here, turned, source))
            a += len(here)
        # join blocks along texts
        entered = np.zeros((count, states), np.int64)
        last = np.repeat(self.prior[None], len(n), axis=0)
        for k in range(int(blocks.max(initial=0))):
            texts = np.flatnonzero(blocks > k)
            at = first[texts] + k
            paths = last[texts][:, :, None] + value[at]
            entered[at] = paths.argmax(axis=1)
            last[texts] = paths.max(axis=1)
        leave = last.argmax(axis=1)
        start, stop = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for k in range(int(blocks.max(initial=0)) - 1, -1, -1):
            texts = np.flatnonzero(blocks > k)
            at = first[texts] + k
            stop[at] = leave[texts]
            start[at] = leave[texts] = entered[at, leave[texts]]
        out = np.empty(len(scored), np.int64)
        for here, turned, source in solved:
            state, row, began, long = stop[here], np.arange(len(here)), start[here], size[here]
            for t in range(len(turned) - 1, -1, -1):
                inside = long > t
                out[begin[here][inside] + t] = state[inside]
                state = np.where(turned[t, row, began, state], source[t, row, began], state)
        return out

    def _solved(self, scored: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For blocks of words the best value of each (language before, language at the end), and at each place whether a
        path changed into a language there, and from which.  Places behind a block's end change nothing."""
        states, steps, count = len(self.languages), int(size.max()), len(begin)
        value = np.where(np.eye(states, dtype=bool), 0.0, -1e9)[None].repeat(count, axis=0)
        turned = np.zeros((steps, count, states, states), bool)
        source = np.zeros((steps, count, states), np.int16)
        for t in range(steps):
            emit = np.where((t < size)[:, None], scored[np.minimum(begin + t, len(scored) - 1)], 0)
            source[t] = value.argmax(axis=2)
            other = np.take_along_axis(value, source[t][:, :, None].astype(np.int64), axis=2) - SWITCH
            turned[t] = other > value
            value = np.where(turned[t], other, value) + emit[:, None, :]
        return value, turned, source

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: of the languages with MAIN of the letters on the best path the one that comes
        first (without any, that with most letters; of equal ones the smaller name), and its share of the letters.
        Letters of scripts that no learned language has count in the whole, not in the share: 0 where there are no others."""
        words, codes, ends = split(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        path = self.labels(self.scores(words)[codes], ends)
        sizes = np.array([len(w) for w in words], np.int64)[codes] if len(codes) else codes
        known = self.scripts.any(axis=0)[script_of(words)][codes] if len(codes) else codes
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        weights = np.bincount(text * len(self.languages) + path, sizes * known, len(texts) * len(self.languages)).reshape(len(texts), -1)
        total, best = np.bincount(text, sizes, len(texts)), weights.argmax(axis=1)
        main = weights >= MAIN * np.maximum(total, 1)[:, None]
        open_ = np.flatnonzero(main[text, path])
        held, first = np.unique(text[open_], return_index=True)
        best[held] = path[open_[first]]
        share = weights[np.arange(len(texts)), best] / np.maximum(total, 1)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best, total)], [float(s) if t else 0.0 for s, t in zip(share, total)]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, start, end) of the runs of words with one label, in characters of the text."""
        found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text or "")]
        if not found or not self.languages:
            return []
        path = self.labels(self.scores([w for w, _, _ in found]), np.array([0, len(found)]))
        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(found)]
        return [(self.languages[path[a]], found[a][1], found[b - 1][2]) for a, b in zip(cut, cut[1:])]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the non-null languages of docs (doc_id, text, lang), from about `sample` documents of each.

    Documents are chosen by a hash of id and text below a share of all hashes, the same on every run: repeated rows are
    all chosen or none.  Languages below a share of RARE teach nothing; without documents no language is known.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r.lang, r.n) for r in counted.join(F.broadcast(counted.agg(F.sum("n").alias("all"))), F.col("n") >= RARE * F.col("all")).collect())
    if not sizes:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    names = [a for a, _ in sizes]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    keep: Column = F.lit(False)
    for name, n in sizes:
        keep = keep | ((F.col("lang") == name) & (draw < int(min(1.0, sample / n) * (1 << 30))))
    drawn = known.where(keep)
    codes = {a: i for i, a in enumerate(names)}

    def count(batches):
        counts = np.zeros((len(names), BUCKETS))
        letters, documents = np.zeros((len(names), len(SCRIPTS))), np.zeros(len(names))
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                k = codes[lang]
                own = [t for a, t in zip(langs, texts) if a == lang]
                documents[k] += len(own)
                for a in range(0, len(own), 200):
                    words, at, _ = split(own[a : a + 200])
                    if not words:
                        continue
                    times = np.bincount(at, minlength=len(words))
                    buckets, owners = grams(words)
                    counts[k] += np.bincount(buckets, times[owners], BUCKETS)
                    letters[k] += np.bincount(script_of(words), times * np.array([len(w) for w in words]), len(SCRIPTS))
        for k in range(len(names)):
            full = np.concatenate((counts[k], letters[k], documents[k : k + 1]))
            some = np.flatnonzero(full)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(full[some].astype(np.int64))], ["k", "at", "n"])

    parts = drawn.select("lang", "text").mapInArrow(count, "k int, at int, n long")
    table = parts.groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros((len(names), BUCKETS + len(SCRIPTS) + 1))
    full[table.k.to_numpy(int), table["at"].to_numpy(int)] = table.n.to_numpy()
    return Model(names, full[:, -1], full[:, :BUCKETS], full[:, BUCKETS:-1])


def identify(docs: DataFrame, model: Model, keep: list[str], with_spans: bool = False) -> DataFrame:
    """keep, lang_pred and score; with_spans adds spans (language, start, end in characters).

    `und` with score 0 for null texts and texts without a letter, and where no language was learned.  A text whose
    letters are all of scripts that no learned language has is named after the likeliest language, with score 0.
    Repeated rows are told alike, an empty table stays empty, texts of any length are told as a whole (a worker holds some
    30 bytes a word), and a kept column called like a new one gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        def apply(texts):
            made = list(shared.value.predict(texts))
            if with_spans:
                made.append([[{"lang": a, "start": b, "end": c} for a, b, c in shared.value.spans(t)] for t in texts])
            return made

        return apply

    return text_pass(docs, keep, "text", [("lang_pred", "string"), ("score", "double")] + [("spans", "array<struct<lang:string,start:int,end:int>>")] * with_spans, begin)
