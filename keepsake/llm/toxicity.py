"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

Two words are alike by the kernel as far as they share subsequences of three
characters, whatever stands in between; each occurrence weighs ``DECAY`` to the
length it spans, so inserted characters and gaps cost similarity but don't
destroy it.  A word is represented by its kernel values to a few landmark words
(Nyström's map); a linear L2 support vector machine on those tells insults
from other words.  Labels belong to documents, not words: in training each
toxic document's sentences stand for their most suspicious words, chosen anew
after each fit, while every word of a clean document is clean.  A document's
score is a logistic function, fitted on documents kept aside, of the largest
and the second largest margin of its words.

Blanks and line breaks are gaps too: every run of adjacent words of up to
``WINDOW`` characters together is also read as one word, without its blanks
("id iot").  A document's best run counts where it beats all of its words; it is
then the first and the best word the second.  The same holds in training: such a
run is a witness of its toxic document, and the worst runs of clean documents
join the clean words after each fit.

Landmarks drop out in use: the machine is one weight per character triple (a
table of fixed size), so scoring is linear in the text and needs no exchange.

Bounds: the fit takes at most ``SAMPLE`` labelled documents of each class, those
with the smallest hashes, of at most ``MAX_CHARS`` characters.  Scores cover
every document and whole texts.

Defined results: null and empty texts get the score of a text without suspicious
words; words over ``WINDOW`` characters are read in overlapping windows; without
labels of both classes every score is 0; repeated rows are scored each; repeated
labels of a document count as toxic if one is; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import methodcaller

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.session import ship_package

#: Kernel: subsequences of three characters, decay per character spanned.
DECAY = 0.7
#: Longest stretch of characters that the kernel reads at once.
WINDOW = 16
#: Labelled documents per class that the fit takes, and the longest text among them.
SAMPLE = 1500
MAX_CHARS = 50_000
#: Landmarks from suspicious and from clean words.
LANDMARKS = 64
ALPHABET = 64
#: Penalty of words inside the margin, per class.
COST = 20_000.0
#: Fits, each with newly chosen witnesses and more of the hardest clean words.
ROUNDS = 6
FOLDS = 5
#: Characters from which on equal runs of words are looked for; shorter ones are computed faster than found.
REPEATS = 7
#: Least margin of a text: that of clean words, also for what holds no word of three characters.
CLEAN = -1.0
#: Tokens whose margins a worker remembers before it starts anew.
REMEMBER = 200_000
_EDGES = ".,;:!?\"'()[]{}<>#$%&*|-_=~…«»„“”"
_cleaned = methodcaller("strip", _EDGES)
_SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def _symbol_table() -> np.ndarray:
    """Code of each character below 0x3000: letters, one code for digits, hashed codes for the rest."""
    table = np.array([59 + c % 3 for c in range(0x3000)], np.int32)
    for c in range(0x3000):
        if chr(c).isalpha():
            table[c] = 27 + c % 32
        elif chr(c).isdigit():
            table[c] = 26
    for i in range(26):
        table[ord("a") + i] = i
    return table


SYMBOLS = _symbol_table()
#: Codes of a word's start and end.
START, STOP = 62, 63
#: Length -> (triples of places, weight of each, norm).
TRIPLES: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    if n not in TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
        weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0) if len(at) else np.zeros(0)
        TRIPLES[n] = at, weight, float(np.sqrt((weight ** 2).sum())) or 1.0
    return TRIPLES[n]


def codes_by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, triple codes, weights over the norm) of words of up to WINDOW characters, by length."""
    lengths = np.array([len(w) for w in words])
    for n in range(3, WINDOW + 1):
        which = np.flatnonzero(lengths == n)
        at, weight, norm = triples(n + 2)
        for k in range(0, len(which), 20_000):
            part = which[k:k + 20_000]
            points = np.array([words[i] for i in part], dtype=f"U{n}").view(np.uint32).reshape(-1, n)
            s = np.full((len(part), n + 2), START, np.int64)
            s[:, 1:-1] = SYMBOLS[np.minimum(points, 0x2FFF)]
            s[:, -1] = STOP
            code = (s[:, at[:, 0]] * ALPHABET + s[:, at[:, 1]]) * ALPHABET + s[:, at[:, 2]]
            yield part, code, weight / norm


def clean_word(token: str) -> str:
    return token.strip(_EDGES)


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens of a text; letters written apart also count as one word."""
    low = text.lower()
    out = set(low.split())
    for run in _SINGLES.findall(low):
        out.add("".join(run.split()))
    return out


class Stream:
    """Texts as one row of characters without blanks, from which runs of adjacent words are read."""

    def __init__(self, texts: list[str | None]):
        found = [list(filter(None, map(_cleaned, t.lower().split()))) if t else [] for t in texts]
        self.joined = "".join("".join(f) for f in found)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = SYMBOLS.astype(np.uint8)[np.minimum(points, 0x2FFF)]
        counts = np.array([len(f) for f in found], np.int64)
        self.owner = np.repeat(np.arange(len(found)), counts)
        self.last = np.repeat(np.cumsum(counts), counts)
        self.place = np.concatenate([[0], np.cumsum([len(w) for f in found for w in f])]).astype(np.int64)

    def runs(self, block: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(texts, first characters, length) of the runs of two words and more of 3 to WINDOW characters."""
        for k in range(0, len(self.owner), block):
            first = np.arange(k, min(k + block, len(self.owner)))
            by_length: list[list[np.ndarray]] = [[] for _ in range(WINDOW + 1)]
            for words in range(2, WINDOW + 1):
                first = first[first + words <= self.last[first]]
                length = self.place[first + words] - self.place[first]
                first, length = first[length <= WINDOW], length[length <= WINDOW]
                if not len(first):
                    break
                for n in range(3, WINDOW + 1):
                    by_length[n].append(first[length == n])
            for n, parts in enumerate(by_length):
                which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                if len(which):
                    yield self.owner[which], self.place[which], n


    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct run of n characters, by character codes; which of those each place is)."""
        keys = []
        for k in range(0, n, 10):  # ten codes of six bits to a number
            key = np.zeros(len(at), np.int64)
            for i in range(k, min(k + 10, n)):
                key = (key << 6) | self.codes[at + i]
            keys.append(key)
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
        new = np.zeros(len(at), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        return at[order[new]], which


def _dot(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """``rows @ vector`` without BLAS, whose threads mostly wait for each other on products as thin as these."""
    return np.einsum("ij,j->i", rows, vector)


def windows_of(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[k:k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


class Machine:
    """A fitted model: a weight per triple, an offset and the logistic coefficients."""

    def __init__(self, weights: np.ndarray, offset: float, logistic: np.ndarray):
        self.weights, self.offset, self.logistic = weights, offset, logistic
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.offset)
        for which, code, weight in codes_by_length(words):
            out[which] += _dot(self.weights[code], weight)
        return out

    def token_margins(self, found: set[str]) -> dict[str, float]:
        """Margins of tokens and of those remembered; words repeat, so each is mostly computed once."""
        if len(self.known) >= REMEMBER:
            self.known = {}
        self.known.update(self._token_margins(list(found.difference(self.known))))
        return self.known

    def _token_margins(self, found: list[str]) -> dict[str, float]:
        short, owner = [], []
        for i, t in enumerate(found):
            for w in windows_of(clean_word(t)):
                if len(w) >= 3:
                    short.append(w)
                    owner.append(i)
        best = np.full(len(found), -np.inf)
        if short:
            np.maximum.at(best, owner, self.margins(short))
        return dict(zip(found, best.tolist()))

    def run_margins(self, stream: Stream, at: np.ndarray, n: int, block: int = 4096) -> np.ndarray:
        """Margins of the n characters from each place on; equal runs are computed once."""
        if n < REPEATS:
            return self._run_margins(stream, at, n, block)
        first, which = stream.distinct(at, n)
        return self._run_margins(stream, first, n, block)[which]

    def _run_margins(self, stream: Stream, at: np.ndarray, n: int, block: int) -> np.ndarray:
        """Margins triple by triple, over blocks that fit a processor's cache."""
        out = np.empty(len(at))
        table = self.weights.astype(np.float32, copy=False)
        take, norm = table.take, triples(n + 2)[2]
        for k in range(0, len(at), block):
            part = at[k:k + block]
            s = [START, *(stream.codes[part + i].astype(np.int64) for i in range(n)), STOP]
            sums = np.zeros((n + 2, len(part)), np.float32)
            code, got = np.empty(len(part), np.int64), np.empty(len(part), np.float32)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    pair = (s[i] * ALPHABET + s[j]) * ALPHABET
                    for m in range(j + 1, n + 2):
                        np.add(pair, s[m], out=code)
                        take(code, out=got, mode="clip")
                        sums[m - i] += got
            out[k:k + block] = _dot(sums.T, DECAY ** np.arange(1.0, n + 3) / norm) + self.offset
        return out

    def largest_run_margins(self, stream: Stream, texts: int) -> np.ndarray:
        """Of each text the largest margin of a run, -inf without runs."""
        best = np.full(texts, -np.inf)
        for owner, at, n in stream.runs():
            np.maximum.at(best, owner, self.run_margins(stream, at, n))
        return best

    def best_runs(self, stream: Stream, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the largest margin of a run (-inf without runs), and that run's place and length."""
        best, place, length = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for owner, at, n in stream.runs():
            m = self.run_margins(stream, at, n)
            order = np.lexsort((-m, owner))
            top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            top = top[m[top] > best[owner[top]]]
            best[owner[top]], place[owner[top]], length[owner[top]] = m[top], at[top], n
        return best, place, length

    def document_margins(self, texts: list[str | None]) -> np.ndarray:
        """The two largest margins of each text's words, or its best run's and best word's if the run's is larger."""
        sets = [tokens(t) if t else set() for t in texts]
        of = self.token_margins(set().union(*sets))
        out = np.full((len(texts), 2), CLEAN)
        for i, s in enumerate(sets):
            margins = [CLEAN, CLEAN, *map(of.__getitem__, s)]
            first = max(margins)
            margins.remove(first)
            out[i] = first, max(margins)
        runs = np.concatenate([self.largest_run_margins(Stream(t), len(t)) for t in _chunks(texts)] or [np.zeros(0)])
        beaten = runs > out[:, 0]
        out[beaten] = np.column_stack([runs, out[:, 0]])[beaten]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(_design(self.document_margins(texts)) @ self.logistic)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _design(margins: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(margins)), np.clip(margins, -3, 3)])


class Landmarks:
    """Nyström's map: kernel values to landmark words, whitened by their own kernel matrix."""

    def __init__(self, words: list[str]):
        rows: dict[int, dict[int, float]] = {}
        for which, code, weight in codes_by_length(words):
            for r, line in zip(which, code):
                cell = rows.setdefault(int(r), {})
                for c, w in zip(line.tolist(), weight.tolist()):
                    cell[c] = cell.get(c, 0.0) + w
        self.codes = np.array(sorted({c for cell in rows.values() for c in cell}), np.int64)
        place = {c: k for k, c in enumerate(self.codes.tolist())}
        self.features = np.zeros((len(self.codes) + 1, len(words)))
        for r, cell in rows.items():
            for c, w in cell.items():
                self.features[place[c], r] = w
        self.column = np.full(ALPHABET ** 3, len(self.codes), np.int64)
        self.column[self.codes] = np.arange(len(self.codes))
        own = self.features.T @ self.features
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values.max()
        self.whiten = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.features.shape[1]))
        for which, code, weight in codes_by_length(words):
            for k in range(0, len(which), 100):
                out[which[k:k + 100]] = np.einsum("wtm,t->wm", self.features[self.column[code[k:k + 100]]], weight)
        return out

    def map(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.whiten

    def weights(self, v: np.ndarray) -> np.ndarray:
        """The linear machine ``v`` as one weight per character triple."""
        out = np.zeros(ALPHABET ** 3)
        out[self.codes] = (self.features @ (self.whiten @ v))[:-1]
        return out


def apart(words: list[str], most: int, alike: float = 0.75) -> list[str]:
    """The first words none of which is nearly another one by the kernel."""
    vectors: dict[int, dict[int, float]] = {}
    for which, code, weight in codes_by_length(words):
        for i, line in zip(which.tolist(), code.tolist()):
            cell = vectors.setdefault(i, {})
            for c, w in zip(line, weight.tolist()):
                cell[c] = cell.get(c, 0.0) + w
    chosen: list[int] = []
    for i in sorted(vectors):
        own = vectors[i]
        if all(sum(w * vectors[j].get(c, 0.0) for c, w in own.items()) < alike for j in chosen):
            chosen.append(i)
            if len(chosen) == most:
                break
    return [words[i] for i in chosen]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L2 support vector machine (squared hinge) by Newton steps on the rows inside the margin."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(40):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + a.T @ z[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.02 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.02 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _stretched(word: str, rng) -> str:
    """A word with a character inserted, as it is written to escape filters."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + "-*._0"[int(rng.integers(5))] + word[at:]


def near_copies(bags: list[list[str]]) -> list[bool]:
    """Which bags share most of their smallest long words (by hash) with an earlier one."""
    seen: dict[str, list[int]] = {}
    out = []
    for i, bag in enumerate(bags):
        few = sorted((w for w in bag if len(w) >= 7), key=lambda w: zlib.crc32(w.encode()))[:6]
        hits = Counter(j for w in few for j in seen.get(w, ()))
        out.append(any(2 * n > len(few) for n in hits.values()))
        if not out[-1]:
            for w in few:
                seen.setdefault(w, []).append(i)
    return out


def _chunks(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def worst_runs(machine: Machine, streams: list[Stream], most: int) -> list[str]:
    """The distinct runs with the largest margins, of those above -1."""
    found: dict[str, float] = {}
    for stream in streams:
        for _, at, n in stream.runs():
            m = machine.run_margins(stream, at, n)
            top = np.argsort(-m)[:2 * most]
            found.update((stream.joined[at[k]:at[k] + n], float(m[k])) for k in top if m[k] > -1)
        if len(found) > 4 * most:
            found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
    return sorted(found, key=lambda w: (-found[w], w))[:most]


def train(texts: list[str], toxic: list[int], prior: float, seed: int = 5) -> Machine:
    """Fits on labelled texts; every fourth text of a class calibrates the logistic function."""
    rng = np.random.default_rng(seed)
    bags = [sorted({w for t in tokens(x) for w in windows_of(clean_word(t)) if len(w) >= 3}) for x in texts]
    copies = near_copies(bags)
    turn, aside = Counter(), []
    for y in toxic:
        turn[y] += 1
        aside.append(turn[y] % 4 == 0)
    seen = [Counter(), Counter()]
    for bag, y, skip, copy in zip(bags, toxic, aside, copies):
        if not skip and not (y and copy):
            seen[y].update(bag)
    bad = [i for i, y in enumerate(toxic) if y and not aside[i] and not copies[i]]
    if not bad or not seen[0]:
        return Machine(np.zeros(ALPHABET ** 3), 0.0, np.array([-30.0, 0.0, 0.0]))
    suspects = sorted((w for w, n in seen[1].items() if seen[0][w] * 50 <= n), key=lambda w: (-seen[1][w], w))
    common = sorted(seen[0], key=lambda w: (-seen[0][w], w))
    chosen = apart(suspects[:2000], LANDMARKS)
    rare = common[6000:]
    clean = common[:6000] + [rare[i] for i in rng.choice(len(rare), min(3000, len(rare)), replace=False)]
    marks = Landmarks(chosen + common[:LANDMARKS])
    clean_x = marks.map(clean)
    own = [[w for w in bags[i] if seen[0][w] * 50 <= seen[1][w]] or bags[i] for i in bad]
    pool = sorted({w for bag in own for w in bag})
    pool_x = marks.map(pool)
    place = {w: k for k, w in enumerate(pool)}
    rate = np.array([seen[1][w] for w in pool], float)  # first choice: the words in most toxic texts
    # words in so many toxic texts and no clean one that chance can't explain them stay witnesses
    share = len(bad) / (len(bad) + sum(not y and not a for y, a in zip(toxic, aside)))
    enough = np.log(len(seen[0]) + 1) / -np.log(share) if share < 1 else np.inf
    sure = [k for k, w in enumerate(pool) if seen[1][w] >= max(3, enough) and not seen[0][w]]
    bad_runs = Stream([texts[i] for i in bad])
    clean_runs = [Stream(t) for t in _chunks([x for x, y, a in zip(texts, toxic, aside) if not y and not a])]
    machine = None
    for turn_ in range(ROUNDS):
        two = [sorted((place[w] for w in bag), key=lambda k: -rate[k])[:2] for bag in own]
        gapped = []
        if machine is not None:  # a run that beats its document's words is a witness in place of the second word
            best, at, length = machine.best_runs(bad_runs, len(bad))
            for i in np.flatnonzero(best > -np.inf):
                if not two[i] or best[i] > rate[two[i][0]]:
                    two[i] = two[i][:1]
                    gapped.append(bad_runs.joined[at[i]:at[i] + length[i]])
        witness = sure + [k for few in two for k in few]
        shown = [pool[k] for k in witness] + gapped
        extra = marks.map([_stretched(w, rng) for w in shown])
        x = np.vstack([pool_x[witness], marks.map(gapped), extra, clean_x])
        y = np.concatenate([np.ones(2 * len(shown)), -np.ones(len(clean))])
        cost = np.concatenate([np.full(2 * len(shown), 0.5 / len(shown)), np.full(len(clean), 1 / len(clean))]) * COST
        v, offset = fit_svm(x, y, cost)
        rate = pool_x @ v + offset
        machine = Machine(marks.weights(v), offset, np.zeros(3))
        if turn_ + 1 < ROUNDS:  # clean words that look worst join the next fit
            all_margins = machine.margins(common)
            known = set(clean)
            worst = [common[k] for k in np.argsort(-all_margins)[:6000] if all_margins[k] > -1 and common[k] not in known]
            joined = [w for w in worst_runs(machine, clean_runs, 3000) if w not in known]
            more = list(dict.fromkeys(worst[:3000] + joined))
            if more:
                clean_x = np.vstack([clean_x, marks.map(more)])
                clean = clean + more
    held = [i for i, a in enumerate(aside) if a] or list(range(len(texts)))
    y = np.array([toxic[i] for i in held], float)
    if 0 < y.sum() < len(y):
        weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        machine.logistic = fit_logistic(_design(machine.document_margins([texts[i] for i in held])), y, weight)
    else:
        machine.logistic = np.array([0.0, 2.0, 0.0])
    return machine


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fits on a bounded sample of the labelled documents outside the held-out fold.

    The sample's ids are picked from the labels alone; at most twice ``sample``
    ids are broadcast to fetch their texts.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .filter("id is not null and y in (0, 1)").filter(fold(F.col("id")) != 0)
             .groupBy("id").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
            .filter(F.char_length("text") <= MAX_CHARS).join(F.broadcast(picked), "id")
            .groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
            .orderBy("id").select("y", "text").toPandas())
    total = sum(n.values())
    return train(rows["text"].tolist(), rows["y"].astype(int).tolist(), n.get(1, 0) / total if total else 0.0)


def score_documents(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast((machine.weights.astype(np.float32), machine.offset, machine.logistic))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Machine(*model.value)
        for texts in batches:
            yield pd.Series(np.concatenate([m.scores(texts[k:k + 1000].tolist()) for k in range(0, len(texts), 1000)])
                            if len(texts) else [], dtype="float64")
    return docs.withColumn(out_col, F.pandas_udf(run, "double")(F.col(f"`{text_col}`")))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score_documents(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), fit(docs, labels, id_col, text_col),
                             text_col)
    return scored.select(id_col, (fold(F.col(f"`{id_col}`")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
