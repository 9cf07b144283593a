"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans in other forms."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
#: A character that no plain word holds. Words without one are plain.
ODD = re.compile(r"[^\sA-Za-zÀ-ÖØ-öø-ÿ.,;:!?]|[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]|[A-ZÀ-ÖØ-Þ]{2}")
#: Where plain words have more than letters and stops behind them: a stop before a letter, or at a token's start.
STOP = re.compile(r"[.,;:!?](?=[A-Za-zÀ-ÖØ-öø-ÿ])|(?<!\S)[.,;:!?]")
HINT = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login", re.IGNORECASE)
AROUND = "\"'`.,;:!?()[]{}<>"
#: Labels: outside, first token of a secret, a later one.
O, B, I = 0, 1, 2  # noqa: E741
TOKEN = re.compile(r"\S+")
CACHE = 200_000

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches, by start, then kind. Lengths that the patterns ask for are part of them, but for ``assign``."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment its value. What the model learns from."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]


def core(token: str, at: int) -> tuple[int, int]:
    """Where the token stands in the text without quotes, brackets and stops around it."""
    a = len(token) - len(token.lstrip(AROUND))
    b = len(token.rstrip(AROUND))
    return (at + a, at + b) if a < b else (at, at + len(token))


def tokens_of(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the tokens: runs without white space."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def odd_tokens(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """The numbers of the tokens that are not plain words."""
    out = []
    at = 0
    while m := ODD.search(text, at):
        i = bisect_right(starts, m.start()) - 1
        out.append(i)
        at = ends[i]
    return out


def traits(token: str) -> tuple[list[str], list[str]]:
    """Features of a token for itself, and the fewer ones that its neighbours see."""
    inner = token.strip(AROUND) or token
    n = len(inner)
    kinds = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s") for c in inner]
    have = "".join(sorted(set(kinds)))
    size = f"n{min(n.bit_length() * 2 + (n >> max(n.bit_length() - 2, 0) & 1), 16)}"
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) * 4 // max(n, 1)
    own = [f"c:{have}", f"{size}:{have}", f"t{turns}:{have}", f"q{token[:1] in AROUND}{token[-1:] in AROUND}"]
    seen = [f"c:{have}:{min(n, 20) // 5}"]
    if have in ("d", "dl", "l") and n >= 8 and set(inner) <= set("0123456789abcdef"):
        own.append("hex")
    if have in ("u", "du") and n >= 8:
        own.append(f"top:{inner[:4]}")
    for mark in "@.-_/+=:":
        if mark in inner:
            own.append(f"has{mark}")
    if HINT.search(inner):
        own.append("hint")
        seen.append("hint")
        if ":" in token or "=" in token:
            own.append(f"hint+{min(n, 24) // 6}")
    if token.endswith(("=", ":")):
        seen.append("gives")
    return own, seen


def features(window: list[str], i: int, file: str) -> list[str]:
    """All features of a window's token: its own, those of two tokens before and one behind, and the file's."""
    own = traits(window[i])[0]
    seen = lambda name, j: [f"{name}{x}" for x in (traits(window[j])[1] if 0 <= j < len(window) else ["edge"])]
    return ["bias", *own, *seen("p:", i - 1), *seen("pp:", i - 2), *seen("n:", i + 1), file]


def file_feature(odd: int, tokens: int) -> str:
    """What a token's whole file tells: how dense odd tokens are in it."""
    return f"file:{(odd * 64 // max(tokens, 1)).bit_length()}"


@dataclass
class Field:
    """Weights of features by label, and of label pairs."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def decode(self, rows: list[np.ndarray]) -> list[int]:
        """Viterbi labels of a window; what lies outside it is O."""
        best = rows[0] + self.moves[O]
        back = []
        for row in rows[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        label = int((best + self.moves[:, O]).argmax())
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_field(windows: list[list[tuple[list[str], int]]], rounds: int = 80, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Maximum conditional likelihood by forward-backward over all windows at once, with Adam steps.

    Every window is a sequence of (features, label), all between two outside tokens. O to I is impossible.
    """
    names = {f: i for i, f in enumerate(dict.fromkeys(f for w in windows for fs, _ in w for f in fs), 1)}
    n, steps = len(windows), max(map(len, windows), default=1)
    wide = max((len(fs) for w in windows for fs, _ in w), default=1)
    ids = np.zeros((n, steps, wide), np.int32)
    gold = np.zeros((n, steps), np.int64)
    lengths = np.array([len(w) for w in windows])
    for a, w in enumerate(windows):
        for b, (fs, label) in enumerate(w):
            ids[a, b, : len(fs)] = [names[f] for f in fs]
            gold[a, b] = label
    live = np.arange(steps) < lengths[:, None]
    ban = np.zeros((3, 3))
    ban[O, I] = -1e4
    theta = [np.zeros((len(names) + 1, 3)), np.zeros((3, 3))]
    first = [np.zeros_like(t) for t in theta]
    second = [np.zeros_like(t) for t in theta]
    padded = np.where(live, gold, O)
    truth = np.zeros((3, 3))
    np.add.at(truth, (np.hstack([np.zeros((n, 1), np.int64), padded]), np.hstack([padded, np.zeros((n, 1), np.int64)])), 1)
    truth[O, O] -= (~live).sum()
    top = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for turn in range(1, rounds + 1):
        theta[0][0] = 0
        emit = theta[0][ids].sum(axis=2)
        move = theta[1] + ban
        ahead, behind = np.empty((steps, n, 3)), np.empty((steps, n, 3))
        ahead[0] = emit[:, 0] + move[O]
        for t in range(1, steps):
            ahead[t] = np.where(live[:, t, None], top(ahead[t - 1][:, :, None] + move, 1) + emit[:, t], ahead[t - 1])
        whole = top(ahead[-1] + move[:, O], 1)
        behind[-1] = move[:, O]
        for t in range(steps - 1, 0, -1):
            behind[t - 1] = np.where(live[:, t, None], top(move + (emit[:, t] + behind[t])[:, None, :], 2), behind[t])
        belief = np.exp(ahead.transpose(1, 0, 2) + behind.transpose(1, 0, 2) - whole[:, None, None]) * live[:, :, None]
        slope = belief - np.eye(3)[gold] * live[:, :, None]
        step_w = np.stack([np.bincount(ids.ravel(), np.repeat(slope[:, :, k].ravel(), wide), len(names) + 1) for k in range(3)], axis=1)
        pairs = np.zeros((3, 3))
        pairs[O] += belief[:, 0].sum(axis=0)
        last = belief[np.arange(n), lengths - 1]
        pairs[:, O] += last.sum(axis=0)
        for t in range(1, steps):
            joint = np.exp(ahead[t - 1][:, :, None] + move + (emit[:, t] + behind[t])[:, None, :] - whole[:, None, None])
            pairs += (joint * live[:, t, None, None]).sum(axis=0)
        for k, grad in enumerate((step_w, pairs - truth)):
            grad = grad / n + ridge * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return Field({f: theta[0][i] for f, i in names.items()}, theta[1] + ban)


def training_windows(text: str, near: int = 4, every: int = 60) -> list[list[tuple[list[str], int]]]:
    """Windows of a text's tokens with labels from its base matches: around matches, around odd tokens, and some of the rest."""
    spans = value_spans(text)
    starts, ends = tokens_of(text)
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    odd = odd_tokens(text, starts, ends)
    file = file_feature(len(odd), len(words))
    labels = [O] * len(words)
    for a, b in sorted(spans):
        first = bisect_right(ends, a)
        for i in range(first, len(words)):
            if starts[i] >= b:
                break
            labels[i] = B if i == first else I
    held = [i for i, label in enumerate(labels) if label == B]
    other = odd[:: 1 + len(odd) // 4]
    middles = sorted({*held, *other, *range(every // 2, len(words), every)})
    out, done = [], 0
    for i in middles:
        lo, hi = max(done, i - near), min(len(words), i + near + 1)
        if lo <= i:
            out.append([(features(words, j, file), labels[j]) for j in range(lo, hi)])
            done = hi
    return out


#: The patterns as Spark's own regular expression, to choose documents to learn from.
ANY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|(?-i)AKIA[A-Z0-9]{16}|(?-i)[0-9a-f]{24}"""


def fit(docs: DataFrame, sample: int = 2_000, most: int = 6_000) -> Field:
    """A field learned from the base matches of about ``sample`` documents: half of them with matches, half any.

    Matches are counted in all documents, and documents drawn by a hash of id and text, those with matches by their share.
    What comes to the driver is bounded by twice the sample, and of the windows at most ``most`` are used.
    """
    span = 1 << 40
    keyed = docs.where(F.col("text").isNotNull()).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)).alias("h"))
    part = span / max(docs.count(), 1)
    matches = F.col("text").rlike(ANY)
    have = keyed.where(matches).count()
    some = keyed.where(F.col("h") < int(span * min(1.0, sample / 2 / max(have, 1)))).where(matches).limit(sample)
    rest = keyed.where(F.col("h") < int(min(span, part * sample / 2))).limit(sample)
    texts = sorted({r["text"] for r in [*some.select("text").collect(), *rest.select("text").collect()]})
    windows = [w for t in texts for w in training_windows(t)]
    windows = windows[:: max(1, -(-len(windows) // most))]
    return fit_field(windows) if windows else Field({}, np.array([[0.0, -9, -1e4], [0, -9, -9], [0, -9, -9]]))


class Finder:
    """Spans of a text by patterns and field, with the scores of tokens kept between texts."""

    def __init__(self, field: Field):
        self.field = field
        self.zero = np.zeros(3)
        self.known: dict[str, tuple] = {}
        self.edge = [self._sum([name + "edge"]) for name in ("p:", "pp:", "n:")]
        moves = field.moves
        turn = max(moves[a, b] for a in range(3) for b in (B, I)) - moves[O, O] + max(0.0, max(moves[B, O], moves[I, O]) - moves[O, O])
        gains = {f: float(max(w[B], w[I]) - w[O]) for f, w in field.weights.items()}
        # the most that neighbours and file can add: a token shows a shape and perhaps two marks, or is the edge
        best = lambda name: sum(max([0.0, *(g for f, g in gains.items() if f.startswith(name + part))]) for part in ("c:", "hint", "gives", "edge"))
        self.most = best("p:") + best("pp:") + best("n:") + max([0.0, *(g for f, g in gains.items() if f.startswith("file:"))]) + turn
        # words of letters with stops behind them; hints and other stops are tested token by token
        plain = [c + "az"[c in "zZ"] * n + stop for n in range(300) for c in "aAzZ" for stop in ("", ".", "..")]
        self.everything = any(self._scores(w)[4] for w in plain)

    def _sum(self, names: list[str]) -> np.ndarray:
        out = self.zero
        for f in names:
            if (w := self.field.weights.get(f)) is not None:
                out = out + w
        return out

    def _scores(self, token: str) -> tuple:
        """Scores of a token for itself, as the one before, before that and behind, and whether it can leave O at all."""
        if (s := self.known.get(token)) is None:
            own, seen = traits(token)
            self_score = self._sum(["bias", *own])
            can = bool(max(self_score[B], self_score[I]) - self_score[O] + self.most > 0)
            s = (self_score, *(self._sum([name + x for x in seen]) for name in ("p:", "pp:", "n:")), can)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = s
        return s

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of the field that touch no base span.

        A token whose own scores, with the most that neighbours, file and moves can add, keep it outside is
        outside on the best path, so runs of the other tokens are decoded by themselves: the result is
        that of decoding the whole text.
        """
        marked = () if self.everything else [m.start() for p in (STOP, HINT) for m in p.finditer(text)]
        if not self.everything and not marked and not ODD.search(text):
            return []
        starts, ends = tokens_of(text)
        word = lambda i: text[starts[i] : ends[i]]
        odd = odd_tokens(text, starts, ends)
        open_ = [i for i in (range(len(starts)) if self.everything else sorted({*odd, *(bisect_right(starts, at) - 1 for at in marked)})) if self._scores(word(i))[4]]
        if not open_:
            return []
        file = self._sum([file_feature(len(odd), len(starts))])
        part = lambda k, i: self._scores(word(i))[k] if 0 <= i < len(starts) else self.edge[k - 1]
        out = []
        at = 0
        while at < len(open_):
            to = at + 1
            while to < len(open_) and open_[to] == open_[to - 1] + 1:
                to += 1
            run = open_[at:to]
            at = to
            labels = self.field.decode([part(0, i) + file + part(1, i - 1) + part(2, i - 2) + part(3, i + 1) for i in run])
            for i, label in zip(run, labels, strict=True):
                if label == B or (label == I and not (out and out[-1][1] == i - 1)):
                    out.append([i, i])
                elif label == I:
                    out[-1][1] = i
        spans = [("crf", core(word(i), starts[i])[0], core(word(j), starts[j])[1]) for i, j in out]
        return [s for s in spans if not any(x < s[2] and s[1] < y for _, x, y in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base, spans) of every text.

    ``base`` lists the pattern matches as kind:start:end in code points, end exclusive, by start, then kind;
    ``spans`` also those that the field adds where no base span is. Tokens are labelled secret begin, inside
    or outside from their shape, their neighbours and the file, by Viterbi over the whole text.

    Edge cases: null and empty texts have no spans; very long texts and tokens are read whole; repeated rows
    agree; null doc_ids stay; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            counts, base_text, all_text = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = finder.added(text or "", base)
                counts.append([sum(s[0] == kind for s in base) for kind in KINDS[:3]] + [len(more)])
                base_text.append(joined(base))
                all_text.append(joined(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))))
            numbers = np.array(counts, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, i]) for i in range(4)], pa.array(base_text, pa.string()), pa.array(all_text, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    shape = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, shape)
