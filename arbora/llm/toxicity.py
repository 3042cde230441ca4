"""Toxicity by a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums, over the subsequences of ORDER bytes that both hold within SPAN bytes, DECAY to the power of
the two spans; so characters put between those of an insult weaken the match and do not break it. A text's similarity to a
landmark is the largest that a window of it has, one at most; how often it holds the landmark is counted beside. The
similarities are mapped by the inverse square root of the
landmarks' own kernel matrix, and a linear machine with squared hinge loss is trained on them, its values turned into
probabilities by a logistic fit. Beside the labelled texts it learns toxic ones whose landmarks have a character put in, and
clean ones with a single landmark that no clean text holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import field, give_back, mapped, renamed, small_batches, text_bytes

ORDER, SPAN, DECAY = 4, 6, 0.7
#: The classifier is fitted on a bounded sample of the labelled rows: so many of each class at most, taken by a hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 3_000
#: Bytes of the texts of each class at most, and the share of them that one text may have; longer ones are no examples.
SAMPLE_BYTES, LONGEST_SHARE = 64 << 20, 64
#: Landmarks that tell the classes apart, and landmarks of ordinary text; their lengths in bytes, with the space of a word's start.
LANDMARKS, BACKGROUND, LENGTHS = 48, 2, (4, 5, 6, 7, 8)
#: Landmarks that a toxic text should hold, where it can.
REPEATS = 3
#: Times that a landmark counts at most.
OFTEN = 8
#: Share of the toxic texts that a further landmark must cover.
LEAST_GAIN = 0.01
#: Clean texts into which each landmark is put for training.
SINGLES = 40
#: The kernel is a sum of these powers of the string kernel: the first lets weak matches add up, the other parts whole ones from them.
POWERS = (1, 3)
#: Weights of toxic texts, of those with a character put into their landmarks, of single landmarks, and of clean texts.
SHARES = (0.2, 0.15, 0.15, 0.5)
CHUNK = 1 << 20
#: Between texts: no landmark holds it.
GAP = b"\0" * (2 * SPAN)

#: A-Z to a-z, white space to a space; ASCII punctuation is left out, so that i.d.i.o.t reads as idiot.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\v\f\r" else b for b in range(256))
OUT = bytes(b for b in range(33, 128) if not chr(b).isalnum())
PATTERNS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]


def folded(text: bytes) -> bytes:
    return text.translate(FOLD, OUT)


def subsequences(s: bytes) -> dict[int, float]:
    """Code of each subsequence and the sum of DECAY ** span over its places."""
    out: dict[int, float] = {}
    for i in range(len(s)):
        for p in PATTERNS:
            if i + p[-1] < len(s):
                code = int.from_bytes(bytes(s[i + j] for j in p), "big")
                out[code] = out.get(code, 0.0) + DECAY ** (p[-1] + 1)
    return out


@dataclass
class Model:
    landmarks: list[bytes]
    transforms: list[np.ndarray]
    weights: np.ndarray
    scale: tuple[float, float]

    def __post_init__(self):
        self.prepare()

    def prepare(self) -> None:
        """Tables for the search: the landmarks' subsequences, and for each the landmarks that hold it."""
        own = [subsequences(x) for x in self.landmarks]
        self.norm = np.array([sum(v * v for v in x.values()) for x in own])
        self.codes = np.array(sorted({c for x in own for c in x}), dtype=np.uint32)
        place = {c: i for i, c in enumerate(self.codes.tolist())}
        held: list[list[tuple[int, float]]] = [[] for _ in place]
        for mark, x in enumerate(own):
            for code, weight in x.items():
                held[place[code]].append((mark, weight))
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.mark = np.array([m for x in held for m, _ in x], dtype=np.int64)
        self.weight = np.array([w for x in held for _, w in x])
        self.reach = np.array([len(x) - ORDER + SPAN - ORDER for x in self.landmarks], dtype=np.int64)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.slot(self.codes)] = True

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(12)

    def similarities(self, texts: list[bytes]) -> np.ndarray:
        """For each folded text its similarity to each landmark, then how often it holds each: 0 for once, 1 for OFTEN times or more, by logarithm."""
        texts = [b" " + x for x in texts]  # the first word's start
        starts = np.cumsum([0, *(len(x) + len(GAP) for x in texts)])
        out = np.zeros((len(texts), 2 * len(self.landmarks)))
        data = np.frombuffer(GAP.join([*texts, b""]) + GAP, dtype=np.uint8).astype(np.uint32)
        n = len(data) - SPAN
        if n <= 0 or not len(self.codes):
            return out
        shifted = [data << np.uint32(8 * (ORDER - 1 - k)) for k in range(ORDER)]
        at, code, gain = [], [], []
        for p in PATTERNS:
            codes = shifted[0][:n].copy()
            for k in range(1, ORDER):
                codes |= shifted[k][p[k] : p[k] + n]
            i = np.flatnonzero(self.sieve[self.slot(codes)])
            c = np.minimum(np.searchsorted(self.codes, codes[i]), len(self.codes) - 1)
            same = self.codes[c] == codes[i]
            at.append(i[same])
            code.append(c[same])
            gain.append(np.full(int(same.sum()), DECAY ** (p[-1] + 1)))
        at, code, gain = np.concatenate(at), np.concatenate(code), np.concatenate(gain)
        if not len(at):
            return out
        times = self.first[code + 1] - self.first[code]
        hit = np.repeat(np.arange(len(at)), times)
        entry = np.repeat(self.first[code], times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
        mark, where, value = self.mark[entry], at[hit], gain[hit] * self.weight[entry]
        key = mark * (len(data) + 64) + where
        order = np.argsort(key, kind="stable")
        key, mark, where, value = key[order], mark[order], where[order], value[order]
        total = np.concatenate([[0.0], np.cumsum(value)])
        till = np.searchsorted(key, key + self.reach[mark], "right")
        score = np.minimum(1.0, (total[till] - total[:-1]) / self.norm[mark])
        doc = np.searchsorted(starts, where, "right") - 1
        group = mark * len(texts) + doc
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[doc[edge], mark[edge]] = np.maximum.reduceat(score, edge)
        first = np.concatenate([[True], (where[1:] != where[:-1]) | (mark[1:] != mark[:-1])])  # a window has several hits at its start
        times = np.add.reduceat(first & (score > 0.99), edge)
        out[doc[edge], len(self.landmarks) + mark[edge]] = np.minimum(1.0, np.log(np.maximum(times, 1)) / np.log(OFTEN))
        return out

    def features(self, similar: np.ndarray) -> np.ndarray:
        """Similarities in each power, mapped by the landmarks' own kernel, and counts as they are."""
        n = len(self.landmarks)
        return np.concatenate([*[similar[:, :n] ** p @ t for p, t in zip(POWERS, self.transforms, strict=True)], similar[:, n:]], axis=1)

    def decide(self, similar: np.ndarray) -> np.ndarray:
        return self.features(similar) @ self.weights[:-1] + self.weights[-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.decide(self.similarities(texts)) + b, -30, 30)))


def _grams(text: bytes, length: int, least: int = 1) -> np.ndarray:
    """The different strings of so many letters in a text that holds them so often, as numbers; the first letter may be the space before a word."""
    data = np.frombuffer(b" " + text, dtype=np.uint8)
    if len(data) < length:
        return np.empty(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    letters = np.lib.stride_tricks.sliding_window_view((data >= 97)[1:], length - 1).all(axis=1) & ((data >= 97) | (data == 32))[: len(view)]
    codes = np.zeros(int(letters.sum()), dtype=np.uint64)
    for j in range(length):
        codes = (codes << np.uint64(8)) | view[letters, j].astype(np.uint64)
    codes, n = np.unique(codes, return_counts=True)
    return codes[n >= least]


def choose(toxic: list[bytes], clean: list[bytes], most: int = LANDMARKS, background: int = BACKGROUND) -> list[bytes]:
    """Landmarks: strings that cover the toxic texts and few of the clean ones, greedily; then some frequent in clean ones."""
    pool, ordinary = [], []
    # in some languages the clean texts hold a marker now and then, the toxic ones again and again
    for length, least in product(LENGTHS, (1, 2)):
        sets = [_grams(x, length, least) for x in toxic]
        codes, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
        clean_codes, clean_n = np.unique(np.concatenate([np.empty(0, np.uint64), *(_grams(x, length, least) for x in clean)]), return_counts=True)
        if len(clean_codes):
            seen = np.minimum(np.searchsorted(clean_codes, codes), len(clean_codes) - 1)
            other = np.where(clean_codes[seen] == codes, clean_n[seen], 0)
            ordinary += [] if least > 1 else [(int(clean_n[i]), int(clean_codes[i]).to_bytes(length, "big")) for i in np.argsort(-clean_n, kind="stable")[:background]]
        else:
            other = np.zeros(len(codes), np.int64)
        rare = other / max(len(clean), 1)
        good = (n >= max(3, LEAST_GAIN * len(toxic))) & (n / len(toxic) >= 8 * rare)
        place = {int(c): i for i, c in enumerate(codes[good])}
        cover = np.zeros((len(place), len(toxic)), dtype=bool)
        for d, s in enumerate(sets):
            for c in s[np.isin(s, codes[good])].tolist():
                cover[place[c], d] = True
        pool += [(int(c).to_bytes(length, "big"), float(r) * len(toxic), cover[i]) for i, (c, r) in enumerate(zip(codes[good], rare[good], strict=True))]
    pool.sort(key=lambda x: (-len(x[0]), x[0]))
    found: list[bytes] = []
    if pool:
        cover, cost = np.array([x[2] for x in pool]), np.array([3 * x[1] for x in pool])
        covered, n, new = np.zeros(len(toxic), dtype=np.int64), cover.sum(axis=1), np.ones(len(pool), dtype=bool)
        while len(found) < most:
            gain = np.where(new, cover[:, covered < REPEATS].sum(axis=1) - cost, -1.0)
            best = int(np.argmax(gain))
            if gain[best] < max(3, LEAST_GAIN * len(toxic)):
                break
            best = int(np.flatnonzero(gain >= 0.85 * gain[best])[0])  # the longest that covers nearly as many
            if pool[best][0] not in found:
                found.append(pool[best][0])
            new[best] = False
            covered += cover[best]
            both = (cover & cover[best]).sum(axis=1)
            new &= 2 * both < n + n[best] - both  # parts of the same word occur together
    ordinary = [x for _, x in sorted(ordinary, key=lambda x: (-x[0], x[1]))]
    return [*found, *dict.fromkeys(x for x in ordinary if x not in found)][: len(found) + background]


def kernel(landmarks: list[bytes]) -> np.ndarray:
    own = [subsequences(x) for x in landmarks]
    k = np.array([[sum(v * y.get(c, 0.0) for c, v in x.items()) for y in own] for x in own])
    d = np.sqrt(np.diag(k))
    return k / d[:, None] / d[None, :]


def spaced(text: bytes, landmarks: list[bytes]) -> bytes:
    for x in sorted(landmarks, key=lambda x: (-len(x), x)):
        text = text.replace(x, x[: len(x) // 2] + b"*" + x[len(x) // 2 :])
    return text


def singles(marks: list[bytes], clean: list[bytes], each: int = SINGLES) -> list[bytes]:
    """Clean texts with one landmark put in at a word's start, as it is or with one character in it.

    Only landmarks that no clean text holds, so that one of them tells as much as the many of a toxic text.
    """
    out, random = [], np.random.default_rng(5)
    for x in marks:
        if any(x in b" " + t for t in clean):
            continue
        for j in range(each if clean else 0):
            words = clean[int(random.integers(len(clean)))].split(b" ")
            word = x.strip()
            if j % 2:
                k = int(random.integers(1, len(word)))
                word = word[:k] + b"*" + word[k:]
            k = int(random.integers(len(words) + 1))
            out.append(b" ".join([*words[:k], word, *words[k:]]))
    return out


def train(toxic: list[bytes], clean: list[bytes], n_toxic: int, n_clean: int, ridge: float = 1e-3) -> Model:
    """From folded texts of both classes and the classes' sizes, so that scores fit the share of toxic rows."""
    landmarks = choose(toxic, clean)
    if not landmarks:
        return Model([], [np.zeros((0, 0))] * len(POWERS), np.zeros(1), (0.0, float(np.log((n_toxic + 1) / (n_clean + 1)))))
    own, transforms = kernel(landmarks), []
    for p in POWERS:
        values, vectors = np.linalg.eigh(own**p)
        transforms.append(vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T)
    model = Model(landmarks, transforms, np.zeros((len(POWERS) + 1) * len(landmarks) + 1), (1.0, 0.0))
    # toxic texts are learned a second time with a character put into each landmark
    marks = landmarks[: len(landmarks) - BACKGROUND]
    groups = [toxic, [x for text in toxic if (x := spaced(text, marks)) != text], singles(marks, clean), clean]
    similar = np.concatenate([model.similarities(group[i : i + 64]) for group in groups for i in range(0, len(group), 64)])
    x = np.concatenate([model.features(similar), np.ones((len(similar), 1))], axis=1)
    n = sum(map(len, groups[:3]))
    y = np.array([1.0] * n + [-1.0] * len(clean))
    share = np.where(y > 0, n_toxic / max(n, 1), n_clean / max(len(clean), 1))
    whole = sum(part for part, group in zip(SHARES[:3], groups, strict=False) if group) or 1.0  # what an empty group leaves goes to the others
    each = np.concatenate([np.full(len(group), part / len(group) * (0.5 / whole if k < 3 else 1)) for k, (part, group) in enumerate(zip(SHARES, groups, strict=True)) if group])
    penalty = np.diag([ridge / len(landmarks)] * (x.shape[1] - 1) + [1e-6])
    w, held = np.zeros(x.shape[1]), None
    for _ in range(50):  # Newton steps of the squared hinge loss
        inside = y * (x @ w) < 1
        if held is not None and (inside == held).all():
            break
        held = inside
        weighted = x[inside] * each[inside, None]
        w = np.linalg.solve(penalty + weighted.T @ x[inside], weighted.T @ y[inside])
    model.weights = w
    f = x @ w
    target = np.where(y > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        h = share * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(share * (p - target) * f).sum(), (share * (p - target)).sum()])
        hess = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.scale = (float(a), float(b))
    return model


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows whose fold isn't 0. Labels other than 0 and 1, documents without a text and texts above 1 MB are left out."""
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1)).where(fold_of(F.col("doc_id")) != 0)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(marks, "doc_id")
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    groups = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        # ids first, so that the top rows are found without their texts
        own = rows.where(F.col("toxic") == label)
        ids = own.select("doc_id", F.xxhash64("doc_id").alias("_order")).distinct().orderBy("_order", "doc_id").limit(most)
        texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids.withColumnRenamed("_order", "_place")), "doc_id")
        texts = texts.where(F.octet_length("text") <= SAMPLE_BYTES // LONGEST_SHARE)
        # a few thousand rows: in their order, as many as SAMPLE_BYTES hold
        texts = texts.orderBy("_place", "doc_id", F.xxhash64("text")).limit(2 * most)
        till = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("_place", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
        texts = texts.withColumn("_till", till).where(F.col("_till") <= SAMPLE_BYTES).select("text")
        groups.append(sorted(folded(bytes(x[0] or b"")) for x in texts.collect()))
    model = train(groups[0], groups[1], sizes.get(1, 0), sizes.get(0, 0))
    del groups
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The named columns with score and predicted. Whole texts are scored; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[x] for x in keep), field("score", T.DoubleType()), field("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, at, _ = text_bytes(batch.column("text"))
            out, a = [], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1)
                out.append(own.scores([folded(bytes(data[at[i] : at[i + 1]])) for i in range(a, b)]))
                a = b
            p = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return mapped(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null doc_id isn't held out. Repeated rows score alike.

    Whole texts are scored, CHUNK bytes or one longer text at a time; null texts score as empty ones. Without usable labels
    all rows have one score. An empty table gives no rows. Other columns are ignored.
    """
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, fit(docs, labels), ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with the columns of docs."""
    rows, back = renamed(docs, "text")
    return back(score(rows, fit(docs, labels), rows.columns).where("predicted = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify() of all documents, learned from the labels outside fold 0."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
