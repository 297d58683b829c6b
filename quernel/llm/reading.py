"""Reading level of the prose of each document, in English, German and Chinese, on the scale of sample passages.

A document is reduced to its prose: fenced code, log lines, JSON, table rows, lists of paths, headings, speaker labels and
identifiers between the words go. Features are distributions over the rest: of vocabulary (how strongly the words, or
pairs of Chinese characters, belong to each level in the sample), of word length, of the lengths of single sentences, of
syntax (clause marks a sentence, words that subordinate) and of cohesion (words that connect, and what neighbouring sentences
share). Boosted regression trees learn the level from parts of the passages, in several layouts; the vocabulary of a training
part never comes from its own passage. Out-of-fold predictions calibrate the grades; `validate` judges all of it on passages
that neither trees, vocabulary nor calibration have seen.

The sample is bounded (`MOST_PASSAGES`), so the model is fitted on the driver; counting and scoring run over all texts.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session_worker import kept

#: Passages that the model is fitted on, at most.
MOST_PASSAGES = 20_000
LANGUAGES = ("en", "de", "zh")
LEVELS = 5
LONGEST = 24
FOLDS, COPIES = 8, 16
#: Of the copies of a passage, those that have part of another passage as well.
MIXED = 5

_LABEL = r"(?:[^\W\d_][\w ]{0,24}[:：]\s*)?(?:[-*+•][^\S\n]+)*"
_NOT_PROSE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)"  # code
    rf"|^[ \t]*{_LABEL}(?:\[?\d\d:\d\d:\d\d[^\n]*|\d{{4}}-\d\d-\d\d[T ]\d\d:[^\n]*|[\[{{][\"'{{\[][^\n]*[\]}}]|\|[^\n]*\||(?:[\w.~-]*/)+[\w.-]+)[ \t]*$"  # logs, JSON, tables, paths
    r"|^[ \t]*(?:(?:const|let|var|final|export)[ \t]+)?[A-Za-z_][\w.\[\]]*[ \t]*[-+*/|&:]?=[ \t]*\S[^\n]*$"  # code without a fence: assignments,
    r"|^[^\n]*(?:[{}]|=>|\w\([^()\n]*\);)[ \t]*$"  # blocks and calls,
    r"|^[ \t]*(?:from [\w.]+ import [^\n]+|import [\w.]+(?: as \w+)?;?|(?:async )?(?:def|function) \w+\([^\n]*|\$ [^\n]+)$"  # imports, heads, commands
    r"|^[ \t]*#{1,6} [^\n]*$"  # headings
    r"|`[^`\n]*`|https?://\S+",
    re.M | re.S,
)
_SPEAKER = re.compile(r"^[ \t]*(?:[^\W\d_][\w ]{0,24}[:：])(?=\s|$|[㐀-鿿])", re.M)
_CJK = re.compile(r"[㐀-䶿一-鿿]+")
_EDGE = ".,;:!?\"'()[]{}<>*_-–—…«»„“”‘’`|/\\#~=+&%·、。，；：！？（）「」『』《》"
_STOPS_ZH = re.compile(r"(?:(?<=[㐀-鿿])[.!?]|[。！？])+(?=\s|$|[㐀-鿿])")
_STOPS = re.compile(r"[.!?。！？]+(?=\s|$|[㐀-鿿])")


#: Words that subordinate a clause, and words that connect sentences, in English, German and Chinese.
_SUBORDINATE = "because although though while whereas unless since if that which who whom whose when where whether until weil obwohl während dass ob wenn falls nachdem bevor damit sodass welche welcher welches deren dessen 因为 由于 虽然 尽管 如果 只要 除非 即使 以便 使得".split()
_CONNECT = "however therefore moreover furthermore nevertheless thus hence consequently meanwhile instead also then jedoch daher deshalb außerdem dennoch somit folglich zudem allerdings hingegen dann auch 因此 所以 然而 但是 而且 此外 从而 同时 于是 不过 然后".split()
_CLAUSE, _CLAUSE_ZH = (", ", "; ", ": "), ("，", "；", "：", "、")
STYLE = 8


def style(text: str, chinese: bool, words: Counter) -> tuple[float, ...]:
    """Of the prose's sentences in one script: mean and spread of their log lengths, the share of long ones, clause marks a
    sentence, shares of subordinating and of connecting words, the mean share of words or characters that neighbours have in
    common, and its spread. `words` are its words or pairs of characters, with counts."""
    lengths, overlaps, before = [], [], None
    for sentence in _STOPS.split(text if chinese else text.lower()):
        held = "".join(_CJK.findall(sentence)) if chinese else sentence.split()
        if not held:
            continue
        lengths.append(len(held) / 2 if chinese else len(held))
        own = set(held)
        if before is not None:
            shared = len(own & before)
            overlaps.append(shared / (len(own) + len(before) - shared))
        before = own
    if not lengths:
        return (0.0,) * STYLE
    n, size = len(lengths), max(words.total(), 1)
    logs = [math.log1p(x) for x in lengths]
    mean, shared = sum(logs) / n, sum(overlaps) / max(len(overlaps), 1)
    spread = math.sqrt(max(sum(x * x for x in logs) / n - mean * mean, 0.0)) if n > 1 else 0.0
    uneven = math.sqrt(max(sum(x * x for x in overlaps) / len(overlaps) - shared * shared, 0.0)) if overlaps else 0.0
    marks = sum(map(text.count, _CLAUSE_ZH if chinese else _CLAUSE))
    count = words.get
    return mean, spread, sum(x > 15 for x in lengths) / n, marks / n, sum(count(w, 0) for w in _SUBORDINATE) / size, sum(count(w, 0) for w in _CONNECT) / size, shared, uneven


def prose(text: str) -> str:
    return _SPEAKER.sub(" ", _NOT_PROSE.sub("\n", text))


def word_of(token: str) -> str | None:
    """The token as a word in lower case; None for identifiers, paths, numbers."""
    w = token.strip(_EDGE)
    if not w or not w.isalpha() or (not w.islower() and not w[1:].islower() and not w.isupper() and len(w) > 1):
        return None
    return w.lower()


#: Tokens seen by this worker and the words that they are, emptied when full: texts share most of their tokens.
_SEEN: dict[str, str | None] = {}
_MOST_SEEN = 200_000


def words_of(text: str) -> Counter:
    """Words that aren't Chinese, with counts."""
    words: Counter = Counter()
    if len(_SEEN) > _MOST_SEEN:
        _SEEN.clear()
    for token, n in Counter(text.split()).items():
        try:
            w = _SEEN[token]
        except KeyError:
            w = word_of(token)
            _SEEN[token] = w = None if w is None or _CJK.search(w) else w
        if w is not None:
            words[w] += n
    return words


def counted(text: str) -> tuple[bool, Counter, int, tuple[float, ...]]:
    """Of the script that most of the prose is in: whether it is Chinese; its words or character pairs with counts; the
    number of sentences' ends; its style."""
    return by_script(text)[0]


def by_script(text: str) -> list[tuple[bool, Counter, int, tuple[float, ...]]]:
    """As `counted`, then the same of the prose in the other script, if any. A lone word or character of the other script
    is a loan or the value of a field, unless it ends as a sentence does."""
    text = prose(text)
    runs = _CJK.findall(text)
    words = words_of(text)
    stops = len(_STOPS.findall(text))
    if not runs:
        return [(False, words, stops, style(text, False, words))]
    joined = "|".join(runs)
    pairs = Counter(map(str.__add__, joined, joined[1:]))
    for p in [p for p in pairs if "|" in p]:
        del pairs[p]
    zh_stops = min(len(_STOPS_ZH.findall(text)), stops)
    # against the letters of words only: paths and identifiers between the words are of no language
    if sum(map(len, runs)) * 3 >= sum(len(w) * n for w, n in words.items()):
        other: Counter = Counter()
        for segment in re.split(rf"\n|{_CJK.pattern}", text) if words else ():
            own = words_of(segment)
            if own.total() > 1 or own and re.search(r"\w[.!?](?=\s|$)", segment):
                other += own
        pairs = pairs or Counter(runs)  # without any pair, characters that stand alone
        chinese = style(text, True, pairs)
        return [(True, pairs, zh_stops, chinese), (False, other, stops - zh_stops, style(text, False, other))] if other else [(True, pairs, stops, chinese)]
    latin = style(text, False, words)
    return [(False, words, stops - zh_stops, latin), (True, pairs, zh_stops, style(text, True, pairs))] if pairs else [(False, words, stops, latin)]


@dataclass
class Lexicon:
    """How much each word speaks for each level of its language: rows add up to 1; after the words one row per length for
    words that aren't in the sample."""

    index: dict[str, int]
    table: np.ndarray  # (words + LONGEST + 1, LEVELS)


def lexicon(counts: list[Counter], levels: list[int]) -> Lexicon:
    words = sorted(set().union(*counts)) if counts else []
    index = {w: i for i, w in enumerate(words)}
    n = np.zeros((len(words), LEVELS))
    by_length = np.zeros((LONGEST + 1, LEVELS))
    for c, level in zip(counts, levels, strict=True):
        for w, k in c.items():
            n[index[w], level - 1] += k
            by_length[min(len(w), LONGEST), level - 1] += k
    share = n / np.maximum(n.sum(0), 1)
    lengths = by_length / np.maximum(by_length.sum(0), 1)
    flat = np.full(LEVELS, 1 / LEVELS)
    smooth = lambda p, seen, a: (p / np.maximum(p.sum(1, keepdims=True), 1e-12) * seen + a * flat) / (seen + a)
    return Lexicon(index, np.vstack([smooth(share, n.sum(1, keepdims=True), 1.0), smooth(lengths, by_length.sum(1, keepdims=True), 5.0)]))


def features(texts: list[tuple[bool, Counter, int, tuple[float, ...]]], books: dict[str, Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each text; its language as an index; its words. All sums run over flat arrays of (text, word, count)."""
    owner, size, chinese = [], np.zeros(len(texts)), np.array([t[0] for t in texts], bool)
    ids: dict[str, list[int]] = {k: [] for k in LANGUAGES}
    number, length = [], []
    en, de, zh = (books[k].index for k in LANGUAGES)
    v_en, v_de, v_zh = len(en), len(de), len(zh)
    for i, (is_zh, words, *_) in enumerate(texts):
        owner.append(len(words))
        number.extend(words.values())
        if is_zh:
            ids["zh"].extend(zh.get(w, v_zh + 2) for w in words)
            length.extend([2] * len(words))
        else:
            sizes = [len(w) if len(w) < LONGEST else LONGEST for w in words]
            length.extend(sizes)
            ids["en"].extend([en.get(w, v_en + k) for w, k in zip(words, sizes, strict=True)])
            ids["de"].extend([de.get(w, v_de + k) for w, k in zip(words, sizes, strict=True)])
    at = np.repeat(np.arange(len(texts)), owner)
    n, length = np.array(number, float), np.array(length, float)
    size = np.bincount(at, n, len(texts))
    latin = ~chinese[at] if len(at) else np.empty(0, bool)
    known = {k: np.bincount(at[latin], n[latin] * (np.array(ids[k], int) < len(books[k].index)), len(texts)) for k in ("en", "de")}
    language = np.where(chinese, 2, (known["de"] > known["en"]).astype(int))
    total = np.maximum(size, 1)
    mass = np.zeros((len(texts), LEVELS))
    for k, name in enumerate(LANGUAGES):
        rows = ~latin if name == "zh" else latin
        own, word = at[rows], np.array(ids[name], int)
        mine = language[own] == k
        for level in range(LEVELS):
            mass[:, level] += np.bincount(own[mine], n[rows][mine] * books[name].table[word[mine], level], len(texts))
    mass /= total[:, None]
    mean = np.bincount(at, n * length, len(texts)) / total
    spread = np.sqrt(np.maximum(np.bincount(at, n * length**2, len(texts)) / total - mean**2, 0))
    long = [np.bincount(at, n * (length >= k), len(texts)) / total for k in (6, 9, 12)]
    stops = np.array([t[2] for t in texts], float)
    sentence = np.log1p(total / np.maximum(stops, 1))
    variety = np.array(owner) / np.sqrt(total)
    repeated = 1 - np.bincount(at, (n > 1) * 1.0, len(texts)) / np.maximum(owner, 1)
    grade = mass @ np.arange(1, LEVELS + 1)
    columns = [mass, grade[:, None], mass[:, 3:].sum(1)[:, None], mean[:, None], spread[:, None], *(x[:, None] for x in long), sentence[:, None], np.log1p(size)[:, None], variety[:, None], repeated[:, None], np.array([t[3] for t in texts]).reshape(-1, STYLE), np.eye(3)[language]]
    return np.hstack(columns), language, size * np.where(chinese, 0.5, 1.0)


@dataclass
class Trees:
    """Boosted regression trees of least squares over binned features, of equal depth, nodes in heap order."""

    base: float = 0.0
    rate: float = 0.08
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, bins: int = 48, least: int = 8) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        width = bins + 1
        flat = binned + np.arange(x.shape[1]) * width
        self.base = float(y.mean())
        fitted = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(rounds):
            rest = y - fitted
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            for k in range(inner):
                own = np.flatnonzero(node == k)
                if len(own) >= 2 * least:
                    n = np.bincount(flat[own].ravel(), minlength=width * x.shape[1]).reshape(-1, width).cumsum(1)
                    s = np.bincount(flat[own].ravel(), np.repeat(rest[own], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1)
                    m, t = len(own), rest[own].sum()
                    gain = np.where((n >= least) & (m - n >= least), s**2 / np.maximum(n, 1) + (t - s) ** 2 / np.maximum(m - n, 1), -np.inf)
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] > t**2 / m + 1e-9 and b < len(edges[f]):
                        feature[k], cut[k] = f, edges[f][b]
                node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
            at = node - inner
            leaf = np.bincount(at, rest, inner + 1) / (np.bincount(at, minlength=inner + 1) + 1.0)
            fitted += self.rate * leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = 2**self.depth - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += self.rate * leaf[node - inner]
        return out


@dataclass
class Model:
    books: dict[str, Lexicon]
    trees: Trees
    scale: tuple[float, float]  # calibration: level = a + b * prediction
    errors: dict[str, tuple[int, float, float]]  # language: parts, mean absolute error, share on the right side of 3.5

    def grade(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level from 1 to 5 (fractional), language, words of prose. Of prose in two scripts, the mean level by words, and the
        language of the greater part."""
        parts = [by_script(t) for t in texts]
        first = np.cumsum([0, *map(len, parts)])[:-1].astype(int)
        x, language, words = features([p for ps in parts for p in ps], self.books)
        level = np.clip(self.scale[0] + self.scale[1] * self.trees.predict(x), 1, LEVELS)
        for i in first[[len(ps) > 1 for ps in parts]]:
            level[i] = np.average(level[i : i + 2], weights=words[i : i + 2])
            language[i] = language[i + words[i : i + 2].argmax()]
            words[i] += words[i + 1]
        return level[first], language[first], words[first]


def parts_of(text: str, rnd: random.Random) -> str:
    """Some neighbouring sentences of the passage in a layout as documents have it."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+", text) if s.strip()]
    n = rnd.randint(1, len(sentences)) if sentences else 0
    start = rnd.randint(0, len(sentences) - n) if sentences else 0
    chosen = sentences[start : start + n]
    style = rnd.random()
    if style < 0.2:  # no punctuation, no capitals
        return " ".join(s.rstrip(".!?。！？") for s in chosen).lower()
    if style < 0.3:
        return " - ".join(s.rstrip(".。") for s in chosen) + "."
    return " ".join(chosen)


def _books(passages: list[tuple[str, int, str]], whole: list[tuple], chosen: list[int]) -> dict[str, Lexicon]:
    return {k: lexicon([whole[i][1] for i in chosen if passages[i][0] == k], [passages[i][1] for i in chosen if passages[i][0] == k]) for k in LANGUAGES}


@dataclass
class Sample:
    """Passages in folds, whole passages at a time and evenly over languages and levels, and the texts of each in its layouts."""

    passages: list[tuple[str, int, str]]
    fold: np.ndarray
    whole: list[tuple]
    texts: list[tuple]  # COPIES of each passage
    levels: np.ndarray  # of the texts

    @staticmethod
    def of(passages: list[tuple[str, int, str]], seed: int) -> Sample:
        rnd = random.Random(seed)
        passages = [(lang, level, text) for lang, level, text in passages if lang in LANGUAGES and text and level]
        order = sorted(range(len(passages)), key=lambda i: (passages[i][:2], passages[i][2]))
        fold = np.zeros(len(passages), int)
        for k, i in enumerate(order):
            fold[i] = k % FOLDS
        whole = [counted(t) for _, _, t in passages]
        texts, levels = [], []
        for i, (lang, level, text) in enumerate(passages):
            mates = [j for j in range(len(passages)) if passages[j][0] == lang and fold[j] == fold[i] and passages[j][1] != level]
            for copy in range(COPIES):
                own = text if copy == 0 else parts_of(text, rnd)
                held = counted(own)
                if copy >= COPIES - MIXED and mates:  # a text of two levels has their mean, by words
                    j = rnd.choice(mates)
                    other = parts_of(passages[j][2], rnd)
                    sizes = held[1].total(), counted(other)[1].total()
                    texts.append(counted(f"{own} {other}"))
                    levels.append((level * sizes[0] + passages[j][1] * sizes[1]) / max(sum(sizes), 1))
                else:
                    texts.append(held)
                    levels.append(float(level))
        return Sample(passages, fold, whole, texts, np.array(levels))

    def rows(self, fold: int, without: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, level and language of the texts of a fold, by the vocabulary of the passages of none of the folds `without`."""
        held = [i for i in range(len(self.passages)) if self.fold[i] == fold]
        own = _books(self.passages, self.whole, [i for i in range(len(self.passages)) if self.fold[i] not in without])
        at = [i * COPIES + copy for i in held for copy in range(COPIES)]
        x, _, words = features([self.texts[k] for k in at], own)
        good = words > 0
        return x[good], self.levels[at][good], np.repeat([self.passages[i][0] for i in held], COPIES)[good]

    def outside(self, folds: list[int], without: set[int], used: np.ndarray | None = None):
        """Features, levels, languages of the folds, each by vocabulary of the others, and what trees of the other folds predict."""
        each = [self.rows(f, without | {f}) for f in folds]
        x, y, language = (np.concatenate(c) for c in zip(*each, strict=True))
        x = x if used is None else x[:, used]
        group = np.repeat(folds, [len(e[1]) for e in each])
        said = np.zeros(len(y))
        for f in folds:
            rest = group != f
            said[~rest] = Trees().fit(x[rest], y[rest]).predict(x[~rest]) if rest.any() else y.mean()
        return x, y, language, said


def calibration(said: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    b, a = np.polyfit(said, y, 1) if len(y) > 1 and said.std() > 0 else (1.0, 0.0)
    return float(a), float(b)


def _errors(graded: np.ndarray, y: np.ndarray, language: np.ndarray) -> dict[str, tuple[int, float, float]]:
    return {k: (int((m := language == k).sum()), float(np.abs(graded - y)[m].mean()), float(((graded >= 3.5) == (y >= 3.5))[m].mean())) for k in LANGUAGES if (language == k).any()}


def fit(passages: list[tuple[str, int, str]], seed: int = 7) -> Model:
    """`passages`: language, level, text. The errors are those of out-of-fold predictions, which also calibrate; see `validate`."""
    sample = Sample.of(passages, seed)
    x, y, language, said = sample.outside(sorted(set(sample.fold)), set())
    a, b = calibration(said, y)
    books = _books(sample.passages, sample.whole, list(range(len(sample.passages))))
    return Model(books, Trees().fit(x, y), (a, b), _errors(a + b * said, y, language))


def validate(passages: list[tuple[str, int, str]], vocabulary: bool = True, seed: int = 7) -> dict[str, tuple[int, float, float]]:
    """By language: parts, mean absolute error, share on the right side of 3.5, of passages that nothing has seen: for each fold,
    trees, vocabulary and calibration come from the other folds alone, whose own predictions leave out both folds. Without
    `vocabulary` the trees have no columns of what words say of levels."""
    sample = Sample.of(passages, seed)
    folds = sorted(set(sample.fold))
    used = None if vocabulary else slice(LEVELS + 2, None)
    graded, truth, language = [], [], []
    for f in folds:
        rest = [g for g in folds if g != f]
        if not rest:
            continue
        x, y, _, said = sample.outside(rest, {f}, used)
        a, b = calibration(said, y)
        own, level, lang = sample.rows(f, {f})
        trees = Trees().fit(x, y)
        graded.append(np.clip(a + b * trees.predict(own if used is None else own[:, used]), 1, LEVELS))
        truth.append(level)
        language.append(lang)
    return _errors(*(np.concatenate(c) for c in (graded, truth, language))) if graded else {}


def read_passages(passages: DataFrame) -> list[tuple[str, int, str]]:
    """Language, level and text of the passages that have them; more than MOST_PASSAGES are an error."""
    held = passages.where("lang is not null and level between 1 and 5 and text is not null").select("lang", "level", "text").limit(MOST_PASSAGES + 1).collect()
    if len(held) > MOST_PASSAGES:
        raise ValueError(f"more than {MOST_PASSAGES} passages")
    return sorted((r.lang, int(r.level), r.text) for r in held if r.lang in LANGUAGES and r.text.strip())


def fit_passages(passages: DataFrame) -> Model | None:
    """A model of a table with lang, level and text; rows without them, or in other languages, are left out; without any
    there is no model; more than MOST_PASSAGES are an error."""
    held = read_passages(passages)
    return fit(held) if held else None


def grades(df: DataFrame, model: Model | None, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, lang (of the prose, whatever the table says), words, level (1 to 5, fractional) of each row; a
    row without a word of prose (null, blank, or nothing but code, logs and lists) has null lang and level, and so has
    every row without a model. Whole texts are read.
    """
    schema = df.select(*keys).schema
    clash = {"lang", "words", "level"} & set(keys)
    if clash:
        raise ValueError(f"key columns are named like results: {sorted(clash)}")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang string, words bigint, level double"])
    if model is None:
        none = {"lang": "string", "words": "bigint", "level": "double"}
        return df.select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    packed = cloudpickle.dumps(model)  # bounded by the passages
    name = "reading-" + hashlib.sha256(packed).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(name, lambda: cloudpickle.loads(packed))
        for batch in batches:
            level, language, words = own.grade([t or "" for t in batch.column(len(keys)).to_pylist()])
            none = words == 0
            columns = [pa.array(np.array(LANGUAGES)[language], pa.string(), mask=none), pa.array(np.maximum(words.astype(np.int64), ~none)), pa.array(level, pa.float64(), mask=none)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *columns], names=[*keys, "lang", "words", "level"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, out)


def profile(graded: DataFrame) -> DataFrame:
    """Per source (null is a source) and language: documents with prose, words, mean level and documents of each level."""
    level = F.round("level").cast("int")
    counts = [F.count_if(level == k).alias(f"level_{k}") for k in range(1, LEVELS + 1)]
    return graded.where("level is not null").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("level"), 4).alias("mean_level"), *counts)
