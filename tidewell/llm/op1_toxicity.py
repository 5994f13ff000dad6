"""Toxicity behind disguise: a noisy channel is undone before the words are judged.

A written token is taken for a word that went through a channel: letters may have become digits or signs that
look alike, may be repeated, or set apart by spaces and marks. All ways to read a token form a lattice, in which a
space between single letters may stand for nothing or for the border of two words; the Viterbi path under a
character trigram model of the corpus is its restored spelling. A sparse logistic model over restored words and
their beginnings, learned from labelled documents, then scores the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import fold
from tidewell.llm.op5_quality import draw
from tidewell.llm.vec import steps
from tidewell.tables import table

# The letters of the model ("#" is what surrounds words) and what signs and letters of other scripts may stand for.
LETTERS = "#abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "&": "a", "%": "x", "*": "aeiou",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɡ": "g", "ʏ": "y", "ո": "n", "օ": "o", "ս": "u",
}
N = len(LETTERS)
NEVER = -1e9
_CODE = {c: i for i, c in enumerate(LETTERS)}
#: Labelled rows that the words' weights are fitted on, at most; of no longer texts than ONE, and TOTAL bytes in all.
SAMPLE = 8000
ONE, TOTAL = 1 << 20, 64 << 20
#: Signs of a token that are read together; a longer token is no word, and is read in parts.
LONG = 256
BEGINNINGS = (3, 4, 5, 6)
_SIGN = r"[\w@$!|+(*€£]"
#: Single characters set apart by up to three spaces: at least three in a row.
APART = re.compile(rf"(?<!\S){_SIGN}(?:[ \t]{{1,3}}{_SIGN}){{2,}}(?!\S)")
#: A plain token: letters, with usual punctuation around, nothing twice in a row.
PLAIN = re.compile(r"[(\"'“«¿¡]*([^\W\d_]+)[.,;:!?)\"'”»]*\Z")
TWICE = re.compile(r"(.)\1")
AGAIN = re.compile(r"(.)\1+")
MARKS = re.compile(r"[^\w@$!|+(<*€£¡]+|_+")
EDGES = ".,;:?!)\"'”»“«¿*%&#~^/\\[]{}=-_<>"
WORDS = re.compile(r"[^\W\d_]+")


def collapsed(word: str) -> str:
    """Every letter that stands several times in a row, once."""
    return AGAIN.sub(r"\1", word)


def _mixed(word: str) -> bool:
    """Whether a word has letters of other scripts that look like Latin ones among Latin ones."""
    return not word.isascii() and any(c in READINGS for c in word) and any(c.isascii() for c in word)


def count_trigrams(df: DataFrame, text: str) -> np.ndarray:
    """Counts of letter trigrams of all words of all rows: at most one number for each triple of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        own = np.zeros(0x110000, np.uint8)
        for c, i in _CODE.items():
            own[ord(c)] = i * (c != "#")
        for batch in batches:
            for part in steps(batch, text):
                joined = "\n".join(t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()).lower()
                codes = own[np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
                # Between words stand two boundary signs: one ends a word, two begin the next.
                codes = codes[(codes > 0) | np.r_[True, codes[:-1] > 0]]
                codes = np.insert(codes, np.flatnonzero(codes == 0), 0).astype(np.int64)
                if len(codes) > 2:
                    grams = (codes[:-2] * N + codes[1:-1]) * N + codes[2:]
                    total += np.bincount(grams, minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = df.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N**3, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out.reshape(N, N, N)


def language_model(counts: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """Log probabilities of a letter after two letters, trigrams backed by bigrams, and those by single letters."""
    c3 = counts.astype(float)
    c3[:, 0, 0] = 0
    c3[1:, 0, :] = 0
    c2 = c3.sum(0)
    c1 = c2.sum(0)
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * N)
    p2 = (c2 + strength * p1) / (c2.sum(1, keepdims=True) + strength)
    p3 = (c3 + strength * p2[None]) / (c3.sum(2, keepdims=True) + strength)
    out = np.log(p3)
    # A border within a token ends one word and begins the next: what follows is as likely as at a beginning.
    out[1:, 0, 1:] = out[0, 0, 1:]
    out[:, 0, 0] = 0.0
    return out.astype(np.float32)


Option = tuple[int, int, float]


def lattice(token: str) -> list[list[Option]]:
    """For each run of one character its readings: (letter, second letter or -1, log weight). Letter 0 is none, or a border.

    Of a run of two signs every pair of readings is one; a longer run is a letter, or two of it.
    """
    out: list[list[Option]] = []
    runs_ = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
    letter = [i for i, (c, _) in enumerate(runs_) if c in _CODE and c != "#"]
    first, last = (letter[0], letter[-1]) if letter else (0, len(runs_) - 1)
    for i, (c, n) in enumerate(runs_):
        options: list[Option] = []
        if c in _CODE and c != "#":
            k = _CODE[c]
            options = [(k, -1, 0.0 if n == 1 else -5.0 if n == 2 else -0.5)]
            if n > 1:
                options.append((k, k, 0.0 if n == 2 else -1.0))
        else:
            readings = [_CODE[r] for r in READINGS.get(c, "")]
            options = [(r, -1, -1.0 - 0.3 * (n > 1)) for r in readings]
            if n > 1:
                options += [(r, q, -1.6) for r in readings for q in readings if n == 2 or q == r]
        if i < first or i > last or not options:
            # At the edge a sign may be no letter at all; one without a reading is none anywhere.
            options.append((0, -1, 0.0 if not options else -9.0 if n == 1 else -6.0 if n == 2 else -2.0))
        out.append(options)
    # Inside a word a sign without a reading was between the letters only: it is left out.
    return [o for i, o in enumerate(out) if not (first < i < last and o == [(0, -1, 0.0)])]


#: What a border between spaced letters weighs: a run is read twice, once as if it were few words and once as many.
BORDERS = (-0.7, 1.5)


def spaced_lattice(run: str, border: float = BORDERS[0]) -> list[list[Option]]:
    """The lattice of single signs with spaces between: each space is nothing, or a border, before the letter that follows it.

    A wider space than the others of the run is more likely a border.
    """
    signs, gaps = re.split(r"\s+", run), [len(g) for g in re.findall(r"\s+", run)]
    out: list[list[Option]] = []
    for c, gap in zip(signs, [0, *gaps]):
        options = lattice(c)[0]
        if gap:
            wide = gap > min(gaps)
            borders = [(0, a, w + border + 0.5 * wide) for a, b, w in options if a and b < 0]
            options = [(a, b, w - 4.0 * wide) for a, b, w in options] + borders
        out.append(options)
    return out


def viterbi(lattices: list[list[list[Option]]], model: np.ndarray) -> list[str]:
    """The best spelling of each lattice, with a space at each border: exact, all lattices side by side, by groups of like shape."""
    out = [""] * len(lattices)
    shape = [(max(map(len, x), default=1), len(x)) for x in lattices]
    order = sorted(range(len(lattices)), key=lambda i: shape[i])
    at = 0
    while at < len(order):
        choices, size = shape[order[at]]
        to = at
        while to < len(order) and to - at < 4096 and shape[order[to]][0] == choices and shape[order[to]][1] <= size + size // 4 + 1:
            to += 1
        for i, s in zip(order[at:to], _decode([lattices[i] for i in order[at:to]], model, max(2, choices))):
            out[i] = s
        at = to
    return out


def _decode(group: list[list[list[Option]]], model: np.ndarray, choices: int) -> list[str]:
    n, steps_ = len(group), max(map(len, group)) + 1
    one = np.zeros((steps_, n, choices), np.int16)
    two = np.full((steps_, n, choices), -1, np.int16)
    weight = np.full((steps_, n, choices), NEVER, np.float32)
    weight[:, :, 0] = 0
    rows, at, place, values = [], [], [], []
    for i, lat in enumerate(group):
        for t, options in enumerate(lat):
            for k, option in enumerate(options):
                rows.append(i), at.append(t), place.append(k), values.append(option)
    if rows:
        filled = np.array(values, np.float64)
        where = np.array(at), np.array(rows), np.array(place)
        one[where], two[where], weight[where] = filled[:, 0], filled[:, 1], filled[:, 2]
    # A state is (choice now, choice before): together they tell the last two letters.
    score = np.full((n, choices, choices), NEVER, np.float32)
    score[:, 0, 0] = 0
    zero = np.zeros((n, choices), np.int16)
    end, end_before, pair, first = zero, zero, np.zeros((n, choices), bool), zero
    back = np.zeros((steps_, n, choices, choices), np.int8)
    for t in range(steps_):
        a, b, w = one[t], two[t], weight[t]
        before = np.where(pair[:, :, None], first[:, :, None], end_before[:, None, :])
        # axes: row, new choice, choice now, choice before
        path = score[:, None] + model[before[:, None], end[:, None, :, None], a[:, :, None, None]]
        back[t] = path.argmax(3)
        best = path.max(3)
        both = b >= 0
        second = model[end[:, None, :], a[:, :, None], np.maximum(b, 0)[:, :, None]]
        score = best + w[:, :, None] + np.where(both[:, :, None], second, 0)
        end_before, end, pair, first = end, np.where(both, b, a), both, a
    flat = score.reshape(n, -1).argmax(1)
    now, before = flat // choices, flat % choices
    rows_ = np.arange(n)
    chosen = np.full((steps_, n, 2), -1, np.int16)
    for t in range(steps_ - 1, -1, -1):
        chosen[t, :, 0], chosen[t, :, 1] = one[t, rows_, now], two[t, rows_, now]
        now, before = before, back[t, rows_, now, before].astype(np.int64)
    letters = np.array([" ", *LETTERS[1:], ""])
    return ["".join(s).strip() for s in letters[chosen].transpose(1, 0, 2).reshape(n, -1)]


@dataclass
class Restorer:
    """Restored words of tokens. ``known`` remembers tokens; it starts anew when it is full.

    ``wanted``: collapsed words ("=word") and beginnings that matter to who asks, or None. Letters alone with some of them
    doubled are decoded only if a spelling of theirs could be or begin with one of these: all of them collapse alike.
    """

    model: np.ndarray
    wanted: frozenset[str] | None = None
    room: int = 400_000
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text, small, and its runs of single signs, which have their spaces."""
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        return {*text.split(), *APART.findall(text)}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > self.room:
            self.known.clear()
        odd: list[tuple[str, list[list[Option]]]] = []
        for t in tokens.difference(self.known):
            if not t.isalpha() and any(map(str.isspace, t)):
                self.known[t] = ()
                odd += [(t, spaced_lattice(t, border)) for border in BORDERS]
                continue
            m = PLAIN.match(t)
            if m and not _mixed(m[1]) and not (TWICE.search(m[1]) and self.matters(m[1])):
                self.known[t] = (m[1],)
                continue
            words = WORDS.findall(t)
            core = t.strip(EDGES)
            spelled = {MARKS.sub("", core), MARKS.sub("", t.lstrip(EDGES.replace("!", "")).rstrip(EDGES))}
            spelled = {s for s in spelled if len(s) > 2 and not s.isdigit()}
            self.known[t] = (*words, *(s for s in spelled if s.isalpha() and s not in words))
            odd += [(t, lattice(s[k : k + LONG])) for s in spelled for k in range(0, len(s), LONG)]
        for (t, _), spelling in zip(odd, viterbi([x for _, x in odd], self.model)):
            for word in spelling.split():
                if len(word) > 2 and word not in self.known[t]:
                    self.known[t] += (word,)

    def matters(self, word: str) -> bool:
        if self.wanted is None:
            return True
        own = collapsed(word)
        return "=" + own in self.wanted or any(own[:n] in self.wanted for n in range(1, BEGINNINGS[-1] + 1))

    def words(self, texts: list[str]) -> list[set[str]]:
        """The distinct restored words of each text."""
        found = [self.tokens(t) for t in texts]
        self.learn(set().union(*found))
        known = self.known
        return [{w for t in own for w in known[t]} for own in found]


#: The restorer of a Python worker, which serves all of its tasks that have the same model.
_kept: dict[str, Restorer] = {}


def _restorer(name: str, model: np.ndarray, wanted: frozenset[str] | None = None) -> Restorer:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Restorer(model, wanted)
    return _kept[name]


def _name(model: np.ndarray) -> str:
    return hashlib.sha256(model.tobytes()).hexdigest()


#: A beginning is also told apart by how many words of a text have it, up to so many.
OFTEN = 3


def stems(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) >= n]


def features(words: set[str]) -> set[str]:
    """Of a text's words: each as "=word", and their beginnings, with 2, 3, ... behind those of as many words."""
    count = Counter(b for w in words for b in stems(w))
    out = {"=" + w for w in words}
    for b, n in count.items():
        out.add(b)
        out.update(f"{b}{k}" for k in range(2, min(n, OFTEN) + 1))
    return out


#: Values and bands by which word sets of labelled texts are compared, and the share of equal values of near copies.
_HASHES = np.random.default_rng(11).integers(0, 1 << 32, (2, 32), dtype=np.uint32) | np.uint32(1)
ALIKE = 0.75


def _sketch(words: set[str]) -> bytes:
    x = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.uint32)
    return (x[:, None] * _HASHES[0] + _HASHES[1]).min(0).tobytes()


def distinct_rows(rows: list[tuple[int, str, bytes]]) -> list[tuple[int, str]]:
    """One (label, words) of each group of rows of one label whose word sets are nearly alike, as their sketches tell."""
    rows = sorted(rows)
    sketches = np.array([np.frombuffer(s, np.uint32) for _, _, s in rows])
    head: dict[tuple, list[int]] = {}
    kept = []
    for i, (label, words, _) in enumerate(rows):
        keys = [(label, band, sketches[i, band : band + 4].tobytes()) for band in range(0, 32, 4)]
        if any((sketches[j] == sketches[i]).mean() >= ALIKE for key in keys for j in head.get(key, ())):
            continue
        kept.append((label, words))
        for key in keys:
            head.setdefault(key, []).append(i)
    return kept


def _telling(n: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """How unlikely it is, in logs, that a feature of no meaning has at least ``n`` of its ``total`` rows in label 1 (a Chernoff bound)."""
    p = np.clip(n / total, 1e-9, 1 - 1e-9)
    bound = total * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return np.where(p > share, bound, 0.0)


def fit(labelled: DataFrame, text: str, label: str, model: np.ndarray, unlikely: float = 12.0, rounds: int = 2500) -> tuple[dict[str, float], dict[str, float], float]:
    """Weights of words and beginnings, what a single one of them tells, and the bias, from a bounded table of whole texts with labels 0 and 1.

    Near copies of one label count once, so that the wording of a few copied documents is not learned. A feature counts
    if it is three times as frequent in label 1 as overall, and if that is no chance: its log probability is below
    -``unlikely``, which six documents of label 1 and none of label 0 reach where a tenth has label 1, however many
    documents there are. Without rows of both labels the score is their share.
    """
    shared, key = labelled.sparkSession.sparkContext.broadcast(model), _name(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(key, shared.value)
        for batch in batches:
            for part in steps(batch, text):
                words = restorer.words([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                sketches = pa.array([_sketch(w) for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(label)).cast(pa.int32()), pa.array([" ".join(sorted(w)) for w in words]), sketches], names=["label", "words", "sketch"])

    # Bounded by the sample: rows, and bytes of text, of which words are a part.
    found = labelled.select(label, text).mapInArrow(run, "label int, words string, sketch binary").collect()
    rows = distinct_rows([(r["label"], r["words"], bytes(r["sketch"])) for r in found])
    y = np.array([t for t, _ in rows], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return {}, {}, bias
    # Documents are taken one after another, so that only counts of what can matter are held.
    own_features = lambda words: features(set(words.split()))
    inside, overall = Counter(), Counter()
    for t, words in rows:
        if t:
            inside.update(own_features(words))
    inside = Counter({f: n for f, n in inside.items() if n >= 3})
    for _, words in rows:
        overall.update(f for f in own_features(words) if f in inside)
    inside_names = list(inside)
    counts = np.array([[inside[f], overall[f]] for f in inside_names], float).reshape(-1, 2)
    surely = dict(zip(inside_names, _telling(counts[:, 0], counts[:, 1], share) >= unlikely))
    inside = Counter({f: n for f, n in inside.items() if surely[f]})
    kept = {f for f, n in inside.items() if n / overall[f] >= min(0.9, 3 * share)}
    # A beginning counts only where it stands for several words and for more than its longer forms.
    word, longer = Counter(), Counter()
    shorter = lambda f: f[:-2] + f[-1] if f[-1].isdigit() else f[:-1]
    for f, n in inside.items():
        if f[0] == "=":
            for b in stems(f[1:]):
                word[b] = max(word[b], n)
        else:
            longer[shorter(f)] = max(longer[shorter(f)], n)
    names = sorted(f for f in kept if f[0] == "=" or inside[f] >= 1.5 * word[f] and longer[f] < 0.95 * inside[f])
    index = {f: i for i, f in enumerate(names)}
    pairs = [(i, index[f]) for i, (_, words) in enumerate(rows) for f in sorted(own_features(words)) if f in index]
    w, doc, feat = np.zeros(len(names)), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
    speed, memory, b_memory = np.zeros(len(names)), np.zeros(len(names)), 0.0
    for _ in range(rounds):
        z = bias + np.bincount(doc, w[feat], len(y))
        wrong = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(feat, wrong[doc], len(names)) + 0.02 * w
        speed = 0.8 * speed + 0.2 * g
        memory += g * g
        step = speed / np.sqrt(memory + 1e-6)
        w = w - 0.5 * step
        w = np.sign(w) * np.maximum(np.abs(w) - 0.0005, 0)
        b_memory += wrong.sum() ** 2
        bias -= 0.5 * wrong.sum() / np.sqrt(b_memory + 1e-6)
    # What one feature tells alone is taken one and a half standard errors lower than counted.
    counted = {f: (inside[f] + 0.5, overall[f] - inside[f] + 2) for f in names}
    alone = {f: float(np.log(x / y) - 1.5 * np.sqrt(1 / x + 1 / y)) for f, (x, y) in counted.items()}
    return {f: float(w[i]) for f, i in index.items() if w[i]}, {f: z for f, z in alone.items() if z > 0}, float(bias)


def score(df: DataFrame, text: str, model: np.ndarray, weights: dict[str, float], alone: dict[str, float], bias: float, name: str = "score") -> DataFrame:
    """Add the probability of label 1 from the restored words of the whole text, and them, those with weight, as ``evidence``.

    Columns of those two names are replaced. Of readings that weigh the same the first in the order of LETTERS counts.

    It is that of the model, or that which the most telling word has alone, if that is higher: one word is enough,
    though most documents that the model has learned from hold several.
    """
    df = df.drop(name, "evidence")
    shared, key = df.sparkSession.sparkContext.broadcast((model, weights, alone)), _name(model) + " ".join(sorted({*weights, *alone}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, own, single = shared.value
        known = {f.rstrip("23456789") for f in (*own, *single)}
        restorer = _restorer(key, table_, frozenset("=" + collapsed(f[1:]) if f[0] == "=" else collapsed(f) for f in known))
        judged: dict[str, bool] = {}
        for batch in batches:
            for part in steps(batch, text):
                z, said = [], []
                if len(judged) > 600_000:
                    judged.clear()
                for words in restorer.words([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]):
                    for w in words:
                        if w not in judged:
                            judged[w] = "=" + w in known or any(b in known for b in stems(w))
                    marked = sorted(w for w in words if judged[w])
                    told = sorted(features(set(marked)))
                    z.append(max(bias + sum(own.get(f, 0.0) for f in told), max((single[f] for f in told if f in single), default=bias)))
                    said.append(marked)
                p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -60, 60)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(said, pa.list_(pa.string()))], names=[*part.schema.names, name, "evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` double, evidence array<string>")


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity. Labels come only from documents outside fold 1 of 3; letter counts from all texts.

    Null and empty texts get the score of a document without a telling word; rows that repeat are scored alike.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model(count_trigrams(docs, "text"))
    sample = draw(table(spark, sf_dir, "labels"), docs, "toxic", fold("doc_id", 3) != 1, SAMPLE, ONE, TOTAL)
    scored = score(docs, "text", model, *fit(sample, "text", "label", model))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.array_join("evidence", " ").alias("evidence"))
