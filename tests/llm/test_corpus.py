"""Filter audit, substring dedup and collocations against plain versions."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import audit, langid, phrases, substrings

DOCS = "doc_id bigint, text string, lang string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def passages(seed, n=60, vocabulary=400):
    """Documents that share passages, with copies, nulls and hot passages."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in rng.integers(0, vocabulary, k)]
    shared = [word(k) for k in (20, 34, 35, 36, 50, 120)]
    hot = word(60)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 4)):
            parts += word(rng.integers(0, 80)) + shared[rng.integers(0, len(shared))] + word(rng.integers(0, 3))
        if i % 3 == 0:
            parts += hot[rng.integers(0, 8) :]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in parts), "en"))
    rows += [(100, rows[5][1], "de"), (101, rows[5][1], None), (101, rows[5][1], None), (102, None, "en"), (None, "a\x0b" * 80, "en"), (103, "", "de"), (104, "x y\x1cz " * 40, "fr")]
    return rows


def removed(texts, window):
    words = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("seed, window, chunk, segment", [(1, 35, 4_000_000, 1 << 22), (2, 35, 900, 300), (3, 10, 2_000, 1 << 22), (4, 7, 1, 64), (5, 1, 5_000, 100)])
def test_substrings_equal_brute_force(spark, monkeypatch, seed, window, chunk, segment):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    rows = passages(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_words": F.lit("own"), "chunk": F.lit(1)}).repartition(3)
    found = Counter((r.id, r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs, window).collect())
    assert found == Counter((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], window)))


def test_substrings_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 700)
    rows = passages(6)
    found = Counter(tuple(r) for r in substrings.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert found == Counter((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], 35)))
    assert substrings.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_packed_values():
    rng = np.random.default_rng(1)
    for kind, top in ((np.uint32, 2**32), (np.uint64, 2**64)):
        values = np.sort(rng.integers(0, top, 1000, dtype=kind, endpoint=False))
        assert (substrings.unpack(substrings.pack(values), kind) == values).all()
    assert len(substrings.unpack(substrings.pack(np.zeros(0, np.uint32)), np.uint32)) == 0


def plain_collocations(rows, longest, least, top):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                count["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in chosen.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longer[q] = max(longer[q], a)
        scored = []
        for p, a in chosen.items():
            score, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not (q := longer[p]) or 100 * q < 50 * a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], total[lang], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out)


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    names = ["New York City", "état civil", "à la carte menu", "the", "of", "a", "New", "city", "x", "ÉTAT", " ", "m\x1cn"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        picks = rng.integers(0, len(names), rng.integers(0, 200)) if i % 2 else rng.zipf(1.5, 60) % len(names)
        rows.append((i, "".join(names[k] + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for k in picks), ["en", "de", None, ""][i % 4]))
    return [*rows, (500, None, "en"), (501, "", "it"), (None, "Only one piece", "nl"), (502, "a b " * 3000, "fr"), (502, "a b " * 3000, "fr")]


@pytest.mark.parametrize("seed, longest, least, top, shard, step, bits", [(1, 3, 10, 2000, 1_000_000, 4_000_000, 1 << 28), (2, 3, 4, 25, 300, 500, 1 << 28), (3, 4, 3, 2000, 1000, 100, 1 << 28), (4, 2, 10, 2000, 1000, 1000, 1 << 28), (5, 3, 5, 2000, 500, 1000, 1 << 15)])
def test_collocations_equal_plain_counts(spark, monkeypatch, seed, longest, least, top, shard, step, bits):
    for name, value in (("SHARD_WORDS", shard), ("STEP_PAIRS", step), ("FILTER_BITS", bits), ("SEGMENT", 1 << 22 if seed == 1 else 200)):
        monkeypatch.setattr(phrases, name, value)
    rows = prose(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"phrase": F.lit("own"), "n": F.lit(1)}).repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(docs, longest, least, top).collect())
    assert found == plain_collocations(rows, longest, least, top)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def plain_audit(rows, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    parts = defaultdict(list)
    for key, text, lang in rows:
        t = text or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key is not None and first[t] < key}
        parts[lang or ""].append(({x for x, f in fails.items() if f}, key in good, key in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in docs if own in d[0] and not d[0] & before]
                shapley[part, own] += len(gone)
                out[part, order, step] = [sum(not d[0] & (before | {own}) for d in docs), len(gone), sum(own in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {own} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain_counts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        n, kinds = int(rng.integers(1, 400)), int(rng.integers(20, 600))
        text = " ".join(f"{'WORD' if i % 5 == 0 and k % 4 == 0 else 'word'}{k}" for k in rng.integers(0, kinds, n)) + ("#" if i % 6 == 0 else "")
        rows.append((i, text if i % 4 else "same " * 3, ["en", "de", None, ""][i % 4 if i % 7 else 0]))
    rows += [(1000, rows[1][1], "fr"), (1000, rows[1][1], "fr"), (None, rows[1][1], "fr"), (None, None, "fr"), (3, rows[7][1], "en"), (1001, None, None), (1002, "", "en")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 300, 2)] + [(1000, None, 1), (1000, 1, 0), (None, 1, 1), (7777, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"mask": F.lit("own"), "n": F.lit(1)}).repartition(4)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_nine_languages_and_the_sample_bound(spark):
    """Random-code case, decoded also by plain sums; the bound holds whatever is repeated."""
    rng = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k}": rng.dirichlet(np.full(26, 0.15)) for k in range(9)}
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters), 5, p=own[lang])) for _ in range(n))
    rows = [(i, text(f"l{i % 9}", 40), f"l{i % 9}") for i in range(540)] + [(1000 + i, "same text again", "l0") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    sample = langid.training_sample(docs, "doc_id", "text", "lang", 90).collect()
    assert 45 <= len(sample) <= 90 and {r.lang for r in sample} == set(own)
    assert 45 <= langid.training_sample(docs, "doc_id", "text", "lang", 20).count() <= 90  # ten for each language
    model = langid.fit(docs)
    assert sorted(model["names"]) == sorted(own) and model["words"].shape[0] == 9
    out = langid.predict(docs, model).filter("doc_id < 540").collect()
    held = [r for r in out if r.doc_id % 9 >= 0]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    x = langid.features([r.text for r in out[:30]])
    for r, f in zip(out[:30], x @ model["w"] + model["b"], strict=True):
        losses = [sum(t * np.log1p(np.exp(-s * v)) for t, s, v in zip(model["trust"], word, f, strict=True)) for word in model["words"]]
        assert model["names"][int(np.argmin(losses))] == r.lang_pred
