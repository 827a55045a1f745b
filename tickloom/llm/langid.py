"""Language identification by error-correcting output codes.

Each language has a codeword; one binary logistic classifier on hashed character n-grams
predicts each bit. A text's bits are decoded to the codeword with the least loss, each
bit weighted by how reliable its classifier was in training. Up to five languages get the
exhaustive code, more get the best of many random codes.

Training rows are a bounded sample (``TRAINING_DOCS``) of different texts, chosen by a hash of
the text so that it is the same for every run and however often a text or an id is repeated;
one task learns from it, and only the weights reach the driver. Prediction reads whole texts
and nothing but the text.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bound on the documents of the training sample, over all languages; with more languages than a tenth of it, ten for each.
TRAINING_DOCS, LEAST_DOCS = 2_400, 10
#: Languages up to which their shares are broadcast.
BROADCAST_LANGUAGES = 50_000
BUCKETS = 4_096
SIZES = (1, 2, 3)
STEPS, RATE, DECAY = 120, 8.0, 1e-5
#: Below this probability of the best codeword a prediction is flagged as ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    """The documents kept from training: CRC-32 of the id as text, modulo 4, is 2 (a null id is none)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[str | None], step: int = shared.STEP_CHARS) -> np.ndarray:
    """One row of hashed n-gram frequencies (root, unit length) for each text. A text is counted in parts
    of ``step`` characters, each with what the n-grams of its last characters reach beyond it, so that
    the arrays don't grow with the longest text."""
    out = np.zeros(len(texts) * BUCKETS)
    group: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for a in range(0, len(text), step):
            group.append((i, text[a : a + step + max(SIZES) - 1]))
            held += len(group[-1][1])
            if held >= step:
                _count(group, step, out)
                group, held = [], 0
    if group:
        _count(group, step, out)
    out = np.sqrt(out.reshape(len(texts), BUCKETS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def _count(parts: list[tuple[int, str]], step: int, out: np.ndarray) -> None:
    """Adds the n-grams that start in the first ``step`` characters of each part (row, text) to that row's buckets."""
    points = shared.code_points("".join(t for _, t in parts))
    lengths = np.array([len(t) for _, t in parts], np.int64)
    first, last = parts[0][0], parts[-1][0]
    owner = np.repeat(np.array([i - first for i, _ in parts], np.int64), lengths)
    rows = out[first * BUCKETS : (last + 1) * BUCKETS]
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # points from here to the part's end
    own = np.repeat(lengths, lengths) - room < step
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if n > len(points):
                break
            shifted = np.zeros(len(points), np.uint64)
            shifted[: len(points) - n + 1] = points[n - 1 :]
            h = h * np.uint64(0x100000001B3) + shifted + np.uint64(n)
            if n in SIZES:
                inside = np.flatnonzero(own & (room >= n))
                bucket = (shared.mix(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64)
                rows += np.bincount(owner[inside] * BUCKETS + bucket, minlength=len(rows))


def code(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of k languages, as signs."""
    if k <= 5:
        bits = 2 ** (k - 1) - 1
        return np.array([[1] * bits] + [[1 if b >> (k - 2 - row) & 1 else -1 for b in range(bits)] for row in range(k - 1)])
    rng, best = np.random.default_rng(seed), (-1, None)
    bits = math.ceil(10 * math.log2(k))
    # distances of all pairs are k * k numbers: fewer tries for many languages
    for _ in range(max(1, min(300, 30_000_000 // (k * k)))):
        words = rng.choice([-1, 1], (k, bits))
        words[0, np.abs(words.sum(0)) == k] *= -1  # a bit must tell some languages apart
        distance = (bits - words @ words.T) // 2 + np.eye(k, dtype=int) * bits
        low = int(distance.min())
        if best[1] is None or low > best[0]:
            best = low, words
    return best[1]


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> dict:
    """Classifiers of all bits at once, by accelerated gradient steps."""
    words = code(len(names))
    target = (words[y] + 1) / 2.0
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], words.shape[1]), np.float32), np.zeros(words.shape[1])
    v, c = w.copy(), b.copy()
    for step in range(STEPS):
        gap = (1 / (1 + np.exp(-(x @ v + c))) - target) * weight
        new_w, new_b = v - RATE * (x.T @ gap.astype(np.float32) + DECAY * v), c - RATE * gap.sum(0)
        momentum = step / (step + 3)
        v, c = new_w + np.float32(momentum) * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    right = ((((x @ w + b) > 0) == (target > 0.5)) * weight).sum(0)
    return {"w": w, "b": b, "words": words, "trust": np.maximum(2 * right - 1, 0.05), "names": names}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best codeword and its probability, by weighted logistic loss."""
    f = x @ model["w"] + model["b"]
    loss = (np.logaddexp(0, -f[:, None, :] * model["words"][None]) * model["trust"]).sum(2)
    share = 2.0 ** (2 - len(model["names"])) if len(model["names"]) <= 5 else 4.0 / model["words"].shape[1]
    p = np.exp((loss.min(1, keepdims=True) - loss) * share)
    return loss.argmin(1), p.max(1) / p.sum(1)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int = TRAINING_DOCS) -> DataFrame:
    """Labelled rows (lang, text, place): about bound / languages different texts of each language, but ``LEAST_DOCS`` at
    least; never more than the larger of bound and ``LEAST_DOCS`` for each language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("place"))
    # different texts, so that copies don't thin the sample out
    counts = shared.cut_lineage(rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts")))
    languages = counts.count()
    each = max(LEAST_DOCS, bound // max(1, languages))
    shares = counts.select("lang", (each / F.col("texts") * 1_000_000_007).alias("share"))
    met = rows.join(F.broadcast(shares) if languages <= BROADCAST_LANGUAGES else shares, "lang")
    some = met.filter(F.pmod("place", F.lit(1_000_000_007)) < F.col("share"))
    # the same text under one language counts once; the limit is hard, whatever the hashes are
    different = some.groupBy("place", "lang").agg(F.min("text").alias("text"))
    return different.orderBy(F.xxhash64("place"), "lang").limit(max(bound, each * languages)).select("lang", "text", "place")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model, or None if no row can be learned from. Each sampled text counts whole, and two
    short passages of it count as well so that short texts are known too."""

    def run(batches):
        found = []
        for batch in batches:
            for text, lang, place in zip(*(batch.column(c).to_pylist() for c in (1, 0, 2)), strict=True):
                third = len(text) // 3
                found += [(place, lang, i, text[a : a + size]) for i, (a, size) in enumerate([(0, len(text)), *((a, 60) for a in (third, 2 * third) if third > 60)])]
        if not found:
            return
        found.sort(key=lambda r: r[:3])
        names = sorted({r[1] for r in found})
        x = np.empty((len(found), BUCKETS), np.float32)
        for i in range(0, len(found), 100):
            x[i : i + 100] = features([r[3] for r in found[i : i + 100]])
        y = np.array([names.index(r[1]) for r in found])
        model = train(x, y, names) if len(names) > 1 else {"names": names}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = training_sample(docs, id_col, text_col, lang_col).coalesce(1).mapInArrow(shared.tidy(run), "model binary").collect()  # one row
    return pickle.loads(rows[0]["model"]) if rows else None


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0. Without any labelled row all
    are ``und``; with one language all texts with letters are of it. New columns replace old
    ones of the same name; repeated rows are judged alike; an empty table gives no rows.
    """

    def judged(texts: list[str | None]) -> tuple[list, list, list]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
        if known and len(model["names"]) == 1:
            best, p = np.zeros(len(known), int), np.ones(len(known))
        elif known:
            best, p = decode(model, features([texts[i] for i in known]))
        for k, i in enumerate(known):
            names[i], scores[i] = model["names"][best[k]], float(p[k])
        return names, scores, [s < AMBIGUOUS for s in scores]

    new = ["lang_pred", "score", "ambiguous"]
    held = [c for c in docs.columns if c.lower() not in new]
    at = held.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b in shared.steps(batch.column(at)):
                for c in range(a, b, 500):
                    part = batch.slice(c, min(500, b - c))
                    names, scores, doubt = judged(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())], [*(f"c{i}" for i in range(len(held))), *new])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)))
    fields = ", ".join(f"c{i} {t.dataType.simpleString()}" for i, t in enumerate(rows.schema))
    out = rows.mapInArrow(shared.tidy(run), f"{fields}, lang_pred string, score double, ambiguous boolean")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(held)), *new)
