"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike characters (1d10t), by spacing (i d i o t) and
by repetition (idiooot).  Each hidden stretch is a lattice of what its characters
may stand for; a Viterbi search under a character trigram model, counted over
every document, finds the likeliest restored word; between letters set apart each gap is
a word break or nothing, and the search tells which.  It is exact: a step
has a state for each pair of last letters that the lattice allows (at most
(letters + 1)^2), and stretches of any length are decoded.  A chunk between white
space is cut at the characters that stand for no letter, and decoded in parts and
as a whole, since such a character may also stand between the letters of a word.
A logistic regression on the words and word beginnings of restored texts gives
the score.

Only the fit of the regression looks at labels, of at most ``limit`` documents,
and it keeps at most ``kept`` features; the character counts and the scores cover
all rows.  The labelled documents' words are restored once and kept.

Defined results: a null text scores as the empty text; with no label of either
kind to learn from, every score is 0.5 less a hair (nothing is rejected); empty
tables give empty results; repeated rows score alike, and labels on repeated ids
count once; of ties between readings the one found first stays, so results repeat;
texts are read whole, whatever their length; the score's column replaces one of its
name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import WHITE, held_out, keep, portions

#: Most labelled documents that a fit uses, and most features that it keeps.
LIMIT, KEPT = 20_000, 4_096
BEGINNINGS = range(3, 8)
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçèéêëíîïñóôöùúûüßœæ"
#: What characters stand for in disguised words.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
WORD = re.compile(r"[^\W\d_]+")
#: Single letters or look-alikes with the same kind of gap between them: three or more, of any white space or marks.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*,/~]++[^\W_](?![^\W_])){2,}")
GAP = re.compile(r"[\s.\-_*,/~]+")
REPEATED = re.compile(r"([^\W\d_])\1\1")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
A = len(LETTERS) + 1
#: Restored chunks that a task keeps, and the longest of them.
CACHED, CACHED_LENGTH = 50_000, 64
#: What a gap costs as a word break, and as none: one of the narrowest of its stretch, and a wider one.
NARROW, WIDE = (-2.0, 0.0), (0.0, -2.0)
#: What stands for no letter and so may separate words within a chunk.
PARTS = re.compile("[^\\w" + re.escape("".join(LOOKALIKES)) + "]+|_+")


def letter_codes() -> np.ndarray:
    """The code of each character below 0x180: its place in LETTERS plus one, or zero for what separates words."""
    codes = np.zeros(0x180, np.int64)
    for i, c in enumerate(LETTERS):
        codes[ord(c)] = i + 1
        if len(c.upper()) == 1 and ord(c.upper()) < 0x180:
            codes[ord(c.upper())] = i + 1
    return codes


def count_trigrams(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How often each three characters follow each other, over all texts; at most (letters + 1)^3 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = letter_codes(), np.zeros(A**3, np.int64)
        for batch in portions(batches):
            for raw in batch.column(0).to_pylist():
                points = np.frombuffer((raw or "").encode("utf-32-le"), "<u4")
                c = np.concatenate([[0, 0], codes[np.where(points < 0x180, points, 0)], [0, 0]])
                total += np.bincount(c[:-2] * A * A + c[1:-1] * A + c[2:], minlength=A**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    counts = docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.collect()}


class Channel:
    """Restores disguised stretches under a character trigram model."""

    def __init__(self, trigrams: dict[int, int]):
        counts = np.zeros(A**3)
        for k, n in trigrams.items():
            counts[k] = n
        counts = counts.reshape(A, A, A)
        pairs, single = counts.sum(2), counts.sum((0, 1))
        smooth = (single + 1) / (single.sum() + A)
        self.log = np.log((counts + 20 * smooth) / (pairs[:, :, None] + 20)).tolist()
        self.code = {c: i + 1 for i, c in enumerate(LETTERS)}
        cached = lru_cache(maxsize=CACHED)(self.decode)
        self.restore = lambda chunk: cached(chunk) if len(chunk) <= CACHED_LENGTH else self.decode(chunk)

    def lattice(self, chunk: str) -> list[list[tuple[str, float]]]:
        """For each run of one character the strings that it may stand for, with the channel's cost."""
        steps = []
        for m in re.finditer(r"(.)\1*", chunk):
            c, n = m[1], len(m[0])
            own = [c] if c in self.code else list(LOOKALIKES.get(c, ""))
            if not own:
                steps.append([("", -1.0)])
                continue
            options = [(x, 0.0 if n == 1 else -1.0) for x in own]
            if n > 1:
                options += [(x * 2, 0.0 if n == 2 else -1.5) for x in own]
            if c not in self.code and c in "*!|(+.":
                options.append(("", -3.0))
            steps.append(options)
        return steps

    def decode(self, chunk: str) -> str:
        """The likeliest word of the chunk's lattice; after a space, the likeliest words of letters set apart."""
        return self.search(self.apart(chunk[1:]) if chunk.startswith(" ") else self.lattice(chunk))

    def apart(self, stretch: str) -> list[list[tuple[str, float]]]:
        """The lattice of letters set apart: each gap is a word break or nothing, and wider ones rather a break."""
        pieces, gaps = GAP.split(stretch), GAP.findall(stretch)
        narrow = min(map(len, gaps), default=0)
        steps = self.lattice(pieces[0])
        for gap, piece in zip(gaps, pieces[1:], strict=True):
            as_break, as_none = NARROW if len(gap) == narrow else WIDE
            steps += [[("", as_none), (" ", as_break)], *self.lattice(piece)]
        return steps

    def spaced(self, stretch: str) -> list[str]:
        """The likeliest words of letters set apart."""
        return self.restore(f" {stretch}").split()

    def search(self, steps: list[list[tuple[str, float]]]) -> str:
        """The likeliest text of a lattice; a space ends a word, and the next one begins as any does."""
        # A state holds its probability and the way to it, as a chain that ways with one beginning share.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in steps:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, way) in best.items():
                for s, cost in options:
                    x, y, q = a, b, p + cost
                    for ch in s:
                        z = self.code.get(ch, 0)
                        q += self.log[x][y][z]
                        x, y = (y, z) if z else (0, 0)
                    if (x, y) not in after or after[x, y][0] < q:
                        after[x, y] = (q, (way, s) if s else way)
            best = after
        _, way = max(((p + self.log[a][b][0], way) for (a, b), (p, way) in best.items()), key=lambda x: x[0])
        parts = []
        while way is not None:
            way, s = way
            parts.append(s)
        return "".join(reversed(parts))

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        low = text.lower()
        found: set[str] = set()
        for m in SPACED.finditer(low):
            found.update(self.spaced(m[0]))
        repeats = REPEATED.search(low) is not None
        for chunk in set(low.split()):
            if chunk.isalpha():
                found.add(chunk)
                if repeats and REPEATED.search(chunk):
                    found.add(self.restore(chunk))
                continue
            found.update(WORD.findall(chunk))
            core = EDGES.sub("", chunk)
            if not core:
                continue
            if (k := chunk.index(core)) and chunk[k - 1] in "$@€£!|":
                found.add(self.restore(PARTS.split(chunk[k - 1 :])[0]))  # a disguised first letter
            parts = [p for p in PARTS.split(core) if p]
            for part in {*parts, core}:
                part = EDGES.sub("", part)
                if part and not part.isalpha() and not part.isdigit() or repeats and REPEATED.search(part):
                    found.add(self.restore(part))
        found.discard("")
        return found


def features(words: set[str], known: dict[int, set[str]] | None = None) -> set[str]:
    """Words, and their beginnings of 3 to 7 letters marked by how many words share them: one, two, three or more.

    known: of each length the beginnings to look for, or all.
    """
    found = set(words)
    for n in BEGINNINGS:
        if known is None:
            shared = Counter([w[:n] for w in words if len(w) > n])
        elif own := known.get(n):
            shared = Counter([w[:n] for w in words if w[:n] in own and len(w) > n])
        else:
            continue
        for start, k in shared.items():
            found.add(start + "~")
            if k > 1:
                found.add(start + "~2")
                if k > 2:
                    found.add(start + "~3")
    return found


def beginnings(names) -> dict[int, set[str]]:
    """What features() has to look for, to find the given ones."""
    known: dict[int, set[str]] = {}
    for f in names:
        if "~" in f:
            start = f.partition("~")[0]
            known.setdefault(len(start), set()).add(start)
    return known


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LIMIT, kept: int = KEPT) -> dict:
    """The character model over all docs, and weights from labelled rows that are not held out."""
    trigrams = count_trigrams(docs, text)
    given = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    chosen = given.orderBy(F.xxhash64("_k"), "_k").limit(limit)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_k")
    # Near copies count once as a rule: of texts whose lowest shingle hash is the same, the least is learned from.
    words = rows.withColumn("_w", F.split(F.coalesce("_text", F.lit("")), WHITE))
    shingles = F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    sample = keep(words.withColumn("_near", F.array_min(shingles)).groupBy("_y", "_near").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")).select("_y", "_text"), "labelled")

    channel_of = sample.sparkSession.sparkContext.broadcast(trigrams)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(channel_of.value)
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(channel.words(t or "")) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["_y", "words"])

    sample = keep(sample.mapInArrow(restored, "_y int, words array<string>"), "restored")

    def counted(only: set[str] | None) -> DataFrame:
        """Document frequencies: of all features in texts labelled 1, or of the given ones in the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in portions(batches):
                for words in batch.column(0).to_pylist():
                    own = features(set(words), known)
                    counts.update(own if only is None else own & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

        known = None if only is None else beginnings(only)
        want = 1 if only is None else 0
        return sample.where(F.col("_y") == want).select("words").mapInArrow(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))

    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    model = {"trigrams": trigrams, "weights": {}, "bias": -1e-6}
    if not pos or not neg:
        return model
    # Of the labelled texts at most limit, and of a feature's texts at least one in 400: so at most 400 times a text's features.
    least = max(2, pos // 400)
    ones = {r["feature"]: r["n"] for r in counted(None).where(F.col("n") >= least).collect()}
    zeros = {r["feature"]: r["n"] for r in counted(set(ones)).collect()}

    def strength(f: str) -> float:
        a, b = ones[f] / pos, zeros.get(f, 0) / neg
        return (a - b) / np.sqrt(b + 2 / neg)

    names = sorted((f for f in ones if ones[f] / pos > 2 * (zeros.get(f, 0) + 0.5) / neg), key=lambda f: (-strength(f), f))[:kept]
    index = {f: i for i, f in enumerate(names)}

    starts = beginnings(names)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            own = [sorted(index[f] for f in features(set(words), starts) & index.keys()) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["_y", "own"])

    got = sample.select("_y", "words").mapInArrow(present, "_y int, own array<int>").collect()
    weights, bias = logistic([r["own"] for r in got], np.array([r["_y"] for r in got], float), len(names))
    return model | {"weights": {f: float(w) for f, w in zip(names, weights, strict=True) if w}, "bias": bias}


def logistic(rows: list[list[int]], y: np.ndarray, n: int, penalty: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features: accelerated gradient steps with weights held at zero or above."""
    sizes = np.array([len(r) for r in rows])
    doc, col = np.repeat(np.arange(len(rows)), sizes), np.array([i for r in rows for i in r], np.int64)
    w, ahead, bias, momentum = np.zeros(n), np.zeros(n), -3.0, 1.0
    load = max(1.0, np.bincount(col, minlength=n).max() if len(col) else 1.0)
    step = 4.0 / (load * max(1, sizes.max(initial=1)) ** 0.5)
    for _ in range(rounds):
        z = bias + np.bincount(doc, ahead[col], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient = np.bincount(col, (p - y)[doc], minlength=n) + penalty * ahead
        new = np.maximum(0.0, ahead - step * gradient)
        bias = min(-1.0, bias - 0.5 * float((p - y).mean()))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w, float(bias)


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of each text, 0 to 1, in place of a column of that name."""
    names = [c for c in docs.columns if c != name]
    rows = docs.select(F.col(f"`{text}`").alias("_scored"), *[F.col(f"`{c}`") for c in names])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, weights, bias = Channel(sent.value["trigrams"]), sent.value["weights"], sent.value["bias"]
        known, starts = weights.keys(), beginnings(weights)
        for batch in portions(batches):
            z = np.array([bias + sum(weights[f] for f in features(channel.words(t or ""), starts) & known) for t in batch.column(0).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*names, name])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != name)
    return rows.mapInArrow(run, f"{kept}`{name}` double")


def digests(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What op9 returns."""
    scored = score(docs.select(key, F.col(text).alias("_text")), model, "_text").select(key, "score")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
