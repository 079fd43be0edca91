"""Toxicity with noisy-channel deobfuscation.

Odd words (letters mixed with digits or signs, letters spaced out, letters repeated) are decoded first: each character
may stand for itself, for letters it is written for, or for nothing (separators, repetitions); Viterbi picks the
best path under a letter-pair model counted over all documents.  Each restored word is then scored by the feature of
its own (itself or one of its beginnings) that tells most about the label: the log ratio of that feature's share of the
words of toxic and of clean texts.  A logistic regression sets what a text's word scores mean: the logarithm of their sum,
their mean over the text, and the best odds, among texts that have it, of any one feature.

The letter-pair model knows the letters below U+0530 (Latin, Greek, Cyrillic), since signs stand for Latin letters: its
size is bounded by these alphabets (0x530 squared at most), and no pair is left out.  Words with other letters are
scored as they are.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, and from `sample` of them at most (the
smallest hashes of doc_id), of which near copies count once.  A feature counts if its likelihood ratio against the
label is `evidence` at least (chance gives 6.635 or more to one word of a hundred).  In the regression a text's own
words are taken out of the counts that score it.

Edge cases: null texts are empty and get the score of a text without such words; a null doc_id is held out; labels that
contradict each other count as toxic; without labelled rows of both kinds every score is the smoothed share of toxic
rows (0.5 without any), held below 0.5 by nothing else; repeated rows are scored alike; whole texts count, whatever
their length; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import slices, text_of

#: What signs and digits are written for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l"}
_SPACED = re.compile(r"(?<!\w)\w(?:[ ._*~\-]\w){3,}(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]")
_THRICE = re.compile(r"(.)\1\1")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¿¡…–—‘’“”"
_EDGES = _EDGES.replace("@", "").replace("$", "") + "@$"
_CACHE = 200_000
#: The first code point that the letter-pair model doesn't know.
ALPHABETS = 0x530
#: Occurrences of one word in a text that count.
_REPEATS = 3


@dataclass
class CharModel:
    """Log probabilities of a letter after a letter; ^ begins and $ ends a word."""

    pairs: dict[str, float]
    floor: float = -14.0

    def step(self, a: str, b: str) -> float:
        return self.pairs.get(a + b, self.floor)

    def decode(self, word: str) -> str:
        """The best restored word.  States are the last letter written; every character moves all states on."""
        states: dict[str, tuple[float, tuple]] = {"^": (0.0, ())}
        before = ""
        for ch in word:
            letters = [(ch, -0.1)] if ch.isalpha() else [(x, -0.7) for x in LEET.get(ch, "")]
            after: dict[str, tuple[float, tuple]] = {}
            for last, (score, path) in states.items():
                for letter, cost in letters:
                    s = score + cost + self.step(last, letter)
                    if letter not in after or s > after[letter][0]:
                        after[letter] = (s, (path, letter))
                skip = -0.7 if not ch.isalnum() else -1.5 if ch == before and ch == last else None if letters else -4.0
                if skip is not None and (last not in after or score + skip > after[last][0]):
                    after[last] = (score + skip, path)
            states, before = after, ch
        _, path = max(((s + self.step(last, "$"), path) for last, (s, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))

    def restore(self, word: str) -> str:
        """A lower-case word without its outer signs, decoded if it is odd."""
        bare = word.strip(_EDGES)
        if bare.isalpha():
            return self.decode(bare) if _THRICE.search(bare) and max(bare) < chr(ALPHABETS) else bare
        letters = _LETTERS.findall(bare)
        if max(letters, default="") >= chr(ALPHABETS):
            return "".join(letters)
        return self.decode(bare) if len(letters) >= 2 else ""


def words_of(text: str) -> Counter:
    """How often a lower-case text has a word; letters spaced out are a word too."""
    found = Counter(text.split())
    for m in _SPACED.finditer(text):
        found[m.group()] += 1
    return found


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n)] if len(word) > 1 else []


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter pairs of lower-case words, counted with numpy; 0 stands for what lies outside a word."""
    n = ALPHABETS
    letters = np.array([chr(c).isalpha() for c in range(n)])
    found = np.zeros(n * n, np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            text = "\n".join(part.column("text").to_pylist()).lower()
            if not text:
                continue
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            known = codes < n
            if known.all():
                codes = np.concatenate([[0], np.where(letters[codes], codes, 0), [0]])
                found += np.bincount(codes[:-1] * n + codes[1:], minlength=n * n)
            else:  # beside a letter of another script there is no pair
                plain = np.where(known, codes, 0)
                plain = np.concatenate([[0], np.where(letters[plain], plain, 0), [0]])
                kinds = np.unique(codes[~known])
                other = np.concatenate([[False], np.isin(codes, kinds[[chr(c).isalpha() for c in kinds.tolist()]]), [False]])
                keep = ~(other[:-1] | other[1:])
                found += np.bincount((plain[:-1] * n + plain[1:])[keep], minlength=n * n)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["pair", "n"])


def char_model(docs: DataFrame) -> CharModel:
    counted = docs.select(text_of().alias("text")).mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counted.where("pair <> 0").collect()  # ALPHABETS squared at most, whatever the input
    totals: Counter = Counter()
    for r in rows:
        totals[r.pair // ALPHABETS] += r.n
    write = lambda c, edge: chr(c) if c else edge
    return CharModel({write(r.pair // ALPHABETS, "^") + write(r.pair % ALPHABETS, "$"): math.log(r.n / totals[r.pair // ALPHABETS]) for r in rows})


@dataclass
class Model:
    """known: a feature's rank by how much it tells, its log ratio and its log odds; weights: of what summary() gives."""

    chars: CharModel
    bias: float = 0.0
    base: float = 0.0
    known: dict[str, tuple[int, float, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * 3

    def word_score(self, cache: dict, word: str) -> tuple[float, float] | None:
        """Log ratio and log odds of the feature that tells most of the word."""
        if word in cache:
            return cache[word]
        if len(cache) >= _CACHE:
            cache.clear()
        found = [self.known[f] for f in features_of(self.chars.restore(word)) if f in self.known]
        out = cache[word] = min(found)[1:] if found else None
        return out

    def score(self, text: str, cache: dict) -> float:
        words = words_of(text.lower())
        telling = sorted((one, min(n, _REPEATS)) for w, n in words.items() if (one := self.word_score(cache, w)))
        total = sum(one[0] * n for one, n in telling)
        most = max((one[1] for one, _ in telling), default=self.base)
        x = self.bias + sum(a * b for a, b in zip(self.weights, summary(total, most, sum(words.values()))))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def summary(total: float, most: float, words: int) -> tuple[float, float, float]:
    """What the regression sees of a text."""
    return math.log1p(total), 100 * total / (words + 20), most


def is_held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null doc_id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies and most near copies share it: the smallest hash of five words in a row."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            words = text.lower().encode().split()
            out.append(min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(out, pa.int64())], names=["text", "toxic", "least"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, evidence: float = 6.635) -> Model:
    """Learns from `sample` labelled rows at most, none of them held out."""
    chars = char_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    # rows that share a doc_id may be more than the sample: copies go here, and the rest is bounded below
    texts = texts.mapInArrow(least_shingle, "text string, toxic int, least long").groupBy("least", "toxic").agg(F.min("text").alias("text"))
    texts = texts.orderBy("least", "toxic").limit(sample).repartition(64, "least").select("text", "toxic").persist(StorageLevel.DISK_ONLY)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each feature the texts and words of either kind that have it; of the empty one, all texts and words."""
        kinds = [pa.string(), *[pa.int64()] * 4]
        names = ["f", "n0", "n1", "w0", "w1"]
        found: dict[str, list[int]] = {"": [0] * 4}
        cache: dict[str, list[str]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = features(text, chars, cache)
                for f, n in own.items():
                    row = found.setdefault(f, [0] * 4)
                    row[toxic] += 1
                    row[2 + toxic] += n
                if len(found) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((f, *r) for f, r in found.items())), kinds)], names=names)
                    found = {"": [0] * 4}
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((f, *r) for f, r in found.items())), kinds)], names=names)

    table = texts.mapInArrow(counts, "f string, n0 long, n1 long, w0 long, w1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "w0", "w1"))).persist(StorageLevel.DISK_ONLY)
    size = table.where("f = ''").first()
    clean, toxic = (size.n0, size.n1) if size else (0, 0)
    base = math.log((toxic + 0.5) / (clean + 0.5))
    if not clean or not toxic:
        return Model(chars, base, base)
    # G squared of the feature against the label: how much it tells
    n = clean + toxic
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    seen = F.col("n0") + F.col("n1")
    tells = sum((term(o, e) for o, e in ((F.col("n1"), seen * toxic / n), (F.col("n0"), seen * clean / n), (toxic - F.col("n1"), (n - seen) * (toxic / n)), (clean - F.col("n0"), (n - seen) * (clean / n)))), F.lit(0.0))
    likelier = F.col("n1") * clean > F.col("n0") * toxic
    # few of the sample's words pass: each is in several texts, and far more often in toxic ones
    best = table.where((F.col("f") != "") & likelier).withColumn("tells", F.round(tells, 9)).where(F.col("tells") >= evidence).orderBy(F.desc("tells"), "f").collect()
    index = {r.f: i for i, r in enumerate(best)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text: the telling feature of each word that has one, how often it counts, and the number of words."""
        cache: dict[str, list[str]] = {}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                every, words, found = features(text, chars, cache), words_of(text.lower()), Counter()
                for w, c in words.items():
                    own = [index[f] for f in cached(w, chars, cache) if f in index]
                    if own:
                        found[min(own)] += min(c, _REPEATS)
                rows.append((sorted(found), [found[f] for f in sorted(found)], [every[best[f].f] for f in sorted(found)], sum(words.values())))
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), (ints, ints, ints, pa.int64()))), batch.column("toxic")], names=["x", "c", "w", "n", "y"])

    rows = sorted((tuple(r.x), tuple(r.c), tuple(r.w), r.n, r.y) for r in texts.mapInArrow(vectors, "x array<long>, c array<long>, w array<long>, n long, y int").collect())
    texts.unpersist()
    table.unpersist()
    whole = [size.w0, size.w1]

    def ratio(f: int, words: int = 0, y: int = 0, of: int = 0) -> float:
        """The log ratio of the feature's shares, without `words` of the `of` words of a text of kind y."""
        w, t = [best[f].w0, best[f].w1], list(whole)
        w[y], t[y] = w[y] - words, t[y] - of
        return max(0.0, math.log((w[1] + 0.5) / (t[1] + 1)) - math.log((w[0] + 0.5) / (t[0] + 1)))

    def odds(f: int, y: int | None = None) -> float:
        """Log odds of texts with the feature, without one text of kind y."""
        return math.log((best[f].n1 - (y == 1) + 0.5) / (best[f].n0 - (y == 0) + 0.5))

    x = []
    for found, counted, words, size_of, y in rows:
        total = sum(ratio(f, w, y, size_of) * c for f, w, c in zip(found, words, counted))
        x.append(summary(total, max((odds(f, y) for f in found), default=base), size_of))
    weights, bias = logistic(np.array(x, float), np.array([r[4] for r in rows], float))
    known = {r.f: (i, round(ratio(i), 6), round(odds(i), 6)) for i, r in enumerate(best)}
    return Model(chars, round(bias, 6), base, known, tuple(round(float(w), 6) for w in weights))


def cached(word: str, chars: CharModel, cache: dict[str, list[str]]) -> list[str]:
    found = cache.get(word)
    if found is None:
        if len(cache) >= _CACHE:
            cache.clear()
        found = cache[word] = features_of(chars.restore(word))
    return found


def features(text: str, chars: CharModel, cache: dict[str, list[str]]) -> dict[str, int]:
    """Of each feature the words of a text that have it; the empty one counts all words."""
    found: Counter = Counter()
    words = words_of(text.lower())
    for w, c in words.items():
        for f in cached(w, chars, cache):
            found[f] += c
    found[""] = sum(words.values())
    return found


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression with a small L2 penalty, by Newton's steps over scaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9 * (1 + np.abs(mean))] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([*[penalty] * x.shape[1], 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge @ w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale * mean).sum())


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the named further columns, held_out, score and predicted (1 if score >= 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = sent.value, {}
        for batch in batches:
            for part in slices(batch, "body", 1 << 23):
                found = np.array([model.score(t, cache) for t in part.column("body").to_pylist()])
                rest = [(n, part.column(n)) for n in part.schema.names if n != "body"]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[n for n, _ in rest] + ["score", "predicted"])

    rest = [F.col(c) for c in columns if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *rest, is_held_out().alias("held_out"), text_of().alias("body"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body") + ", score double, predicted int"
    return rows.mapInArrow(scores, shape)
