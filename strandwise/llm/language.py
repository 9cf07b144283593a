"""Language of whole texts and of their spans: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import packed, runs_of, unpacked

#: Buckets of letter triples, and as many of their contexts.
BUCKETS = 1 << 16
#: Pseudo-count of a triple, and the number of letters it is spread over.
SMALL, ALPHABET = 0.1, 40
#: Code points handled at once in a task.
WORK = 500_000

#: First and last code point of the main blocks of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script's number."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    script = np.full(0x110000, len(NAMES) - 1, np.uint8)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            letter[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    for name, lo, hi in SCRIPTS:
        script[lo : hi + 1] = NAMES.index(name)
    return letter, lower, script


@dataclass
class Words:
    """The words (runs of letters) of some texts, and the letter triples in them."""

    triple: np.ndarray
    context: np.ndarray
    first: np.ndarray  # of each word, its first triple
    doc: np.ndarray  # of each word, its text
    start: np.ndarray  # code points in its text
    end: np.ndarray
    script: np.ndarray


def words_of(texts: list[str]) -> Words:
    """A word of n letters has n + 1 triples: of each letter and of the word's end, after the two letters before."""
    letter, lower, script = _tables()
    codes = lower[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    bases = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inside = letter[codes]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    c = np.where(inside, codes, 0).astype(np.uint32)
    before = np.zeros_like(c)
    before[1:] = c[:-1]
    second = np.zeros_like(c)
    second[2:] = np.where(c[1:-1] > 0, c[:-2], 0)
    event = inside.copy()
    event[ends] = True
    at = np.flatnonzero(event)
    context = before[at] * np.uint32(2654435761) + second[at] * np.uint32(2246822519)
    triple = (context + c[at] * np.uint32(3266489917)) * np.uint32(668265263)
    context = context * np.uint32(374761393)
    doc = np.searchsorted(bases, begins, "right") - 1
    return Words((triple >> 16).astype(np.int32), (context >> 16).astype(np.int32), np.searchsorted(at, begins), doc, begins - bases[doc], ends - bases[doc], script[codes[begins]])


@dataclass
class Model:
    """What was learned: languages, log counts of triples and contexts, the scripts of each language."""

    langs: list[str]
    triples: np.ndarray
    contexts: np.ndarray
    scripts: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """log P(word | language), by word and language; far below all others where the word's script rules a language out."""
        if not len(words.first):
            return np.zeros((0, len(self.langs)))
        out = np.add.reduceat(self.triples[words.triple] - self.contexts[words.context], words.first, axis=0).astype(np.float64)
        open_ = self.scripts[words.script]
        known = open_.any(axis=1)
        out[~known] = 0
        return np.where(open_ | ~known[:, None], out, out - 50)


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of triples, contexts and scripts by language, summed in the task: (lang, kind, bucket, n)."""
    sums: dict[str, np.ndarray] = {}
    offset = 2 * BUCKETS
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        by: dict[str, list[str]] = {}
        for text, lang in rows:
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total = sums.setdefault(lang, np.zeros(offset + len(NAMES), np.int64))
            for part in runs_of(texts, map(len, texts), WORK):
                w = words_of(part)
                total[:BUCKETS] += np.bincount(w.triple, minlength=BUCKETS)
                total[BUCKETS:offset] += np.bincount(w.context, minlength=BUCKETS)
                total[offset:] += np.bincount(w.script, minlength=len(NAMES))
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(total[at])})


def fit(docs: DataFrame, sample: int = 8_000, share: float = 0.02) -> Model:
    """Learn from text and lang of the documents that are not held out and have both.

    Learned on about ``sample`` of them, chosen by a hash of doc_id (all, if there are fewer): the model's
    size is bounded by buckets times languages. A script belongs to a language if at least ``share`` of
    the language's words begin in it.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    have = train.select("lang").count()
    if have > sample:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / have))
    counted = train.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    total = np.zeros((2 * BUCKETS + len(NAMES), len(langs)))
    total[rows["bucket"], np.searchsorted(langs, rows["lang"])] = rows["n"]
    seen = total[2 * BUCKETS :]
    return Model(langs, np.log(total[:BUCKETS] + SMALL).astype(np.float32), np.log(total[BUCKETS : 2 * BUCKETS] + SMALL * ALPHABET).astype(np.float32), seen >= np.maximum(share * seen.sum(axis=0), 1))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each sequence of (steps, labels) scores when every change of label costs ``penalty``.

    All sequences go step by step together, the longest first.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    best = np.array([scores[i][0] for i in order])
    back = []
    for t in range(1, lengths[0] if len(lengths) else 0):
        m = int((lengths > t).sum())
        top = best[:m].argmax(axis=1)
        jump = best[np.arange(m), top] - penalty
        move = jump[:, None] > best[:m]
        back.append((move, top))
        best[:m] = np.where(move, jump[:, None], best[:m]) + np.array([scores[i][t] for i in order[:m]])
    label = best.argmax(axis=1)
    paths = [np.empty(n, np.int64) for n in lengths]
    for t in range(len(back), -1, -1):
        m = int((lengths > t).sum())
        for k in range(m):
            paths[k][t] = label[k]
        if t:
            move, top = back[t - 1]
            label[:m] = np.where(move[np.arange(m), label[:m]], top, label[:m])
    out = [paths[0]] * len(order)
    for k, i in enumerate(order):
        out[i] = paths[k]
    return out


def label_words(scores: np.ndarray, firsts: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of all words; ``firsts``: the first word of each text, none of them empty.

    With k the best single label of a text, no path beats it if no run of words gains more than half a
    penalty by any other label: a path with m runs of others gains m halves at most and pays m penalties,
    or m - 1 if it never uses k. That is checked for all texts at once by running sums; only the rest is
    decoded step by step. Results are those of a full decoding.
    """
    lengths = np.diff(np.append(firsts, len(scores)))
    totals = np.add.reduceat(scores, firsts, axis=0)
    k = totals.argmax(axis=1)
    labels = np.repeat(k, lengths)
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    shift = np.repeat(np.arange(len(firsts)) * -(2.0 * np.abs(gain).sum(axis=0).max() + 1), lengths)[:, None]
    after = np.cumsum(gain, axis=0) + shift
    least = np.minimum.accumulate(after - gain, axis=0)
    most = np.maximum.reduceat((after - least).max(axis=1), firsts)
    rest = np.flatnonzero(most > penalty / 2)
    for part in runs_of(list(rest), (int(lengths[i]) for i in rest), 200_000):
        for i, path in zip(part, viterbi([scores[firsts[i] : firsts[i] + lengths[i]] for i in part], penalty), strict=True):
            labels[firsts[i] : firsts[i] + lengths[i]] = path
    return labels


def _predict(model: Model, penalty: float):
    """Arrow batches of (text, ...) to those with lang_pred, score and spans."""
    langs = np.array(model.langs, dtype=object)

    def decode(texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        words = words_of(texts)
        out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
        if not len(words.first) or not len(langs):
            return out
        scores = model.scores(words)
        firsts = np.flatnonzero(np.append(True, words.doc[1:] != words.doc[:-1]))
        labels = label_words(scores, firsts, penalty)
        cuts = np.flatnonzero(np.append(True, (words.doc[1:] != words.doc[:-1]) | (labels[1:] != labels[:-1])))
        lasts = np.append(cuts[1:], len(labels)) - 1
        weight = np.zeros((len(firsts), len(langs)))
        np.add.at(weight, (np.searchsorted(firsts, np.arange(len(labels)), "right") - 1, labels), words.end - words.start)
        totals = np.add.reduceat(scores, firsts, axis=0)
        sure = np.exp(totals - totals.max(axis=1, keepdims=True))
        top = (weight + 1e-9 * sure / sure.sum(axis=1, keepdims=True)).argmax(axis=1)
        row = np.arange(len(firsts))
        sure = np.where(totals.argmax(axis=1) == top, sure[row, top] / sure.sum(axis=1), 1.0)
        score = weight[row, top] / weight.sum(axis=1) * sure
        spans = np.searchsorted(cuts, np.append(firsts, len(labels)))
        for d, i in enumerate(words.doc[firsts]):
            own = [{"start": int(words.start[a]), "end": int(words.end[b]), "lang": langs[labels[a]]} for a, b in zip(cuts[spans[d] : spans[d + 1]], lasts[spans[d] : spans[d + 1]], strict=True)]
            out[i] = (langs[top[d]], float(score[d]), own)
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = [x for part in runs_of(texts, map(len, texts), WORK) for x in decode(part)]
            for i, (name, values) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("spans", kind))):
                batch = batch.append_column(name, pa.array([x[i] for x in made], values))
            yield batch

    return run


def identify(docs: DataFrame, model: Model, penalty: float = 20.0) -> DataFrame:
    """``docs`` with lang_pred, score and spans (code-point start, end and language), from ``text`` alone.

    A word is a run of letters; its candidates are the languages of its first letter's script (all, if no
    learned language has it), its scores log-probabilities of its letter triples. Labels come from Viterbi
    with ``penalty`` for each change. lang_pred has the most letters; score is its share of the letters
    times its probability against the other languages over the whole text.

    Edge cases: null, empty or letterless text is ``und`` with score 0 and no spans, and so is every text if
    nothing could be learned; repeated rows agree; columns of the three names are replaced, all others stay.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    shape = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<start:int,end:int,lang:string>>").alias("spans")).schema
    return docs.mapInArrow(_predict(model, penalty), shape)


def known_language(docs: DataFrame, sure: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` with letters in a learned language: lang_pred is not ``und`` and score at least ``sure``."""
    made = identify(packed(docs, "text"), fit(docs, **options))
    return made.where((F.col("lang_pred") != "und") & (F.col("score") >= sure)).select(*unpacked(docs.columns, "text"))
