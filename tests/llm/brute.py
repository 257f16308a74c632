"""The same results by plain loops over whole tables, for small fixtures."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cohortry.llm import quality, secrets
from cohortry.llm.text import Texts, slices, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def one_text(text) -> Texts:
    return next(slices(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})))


def word_hash(word, fold=False):
    return one_text(word).words(fold=fold).hashes[0]


# Near-duplicates


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components(sets: list[set], percent: int) -> list[int]:
    """Lowest index that each set is connected with, over all pairs of sets."""
    of = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


# Decontamination


def hit_words(text, items, width=10):
    """Positions of words inside any window of the items, and the items found."""
    words = PLAIN.findall((text or "").translate(FOLD))
    hit, named = set(), set()
    for item_id, item in items:
        own = PLAIN.findall((item or "").translate(FOLD))
        n = min(width, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                named.add(item_id)
    return hit, named


# Quality


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, run in enumerate(zip(words, words[1:], words[2:])) if runs[run] > 1 for j in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def base_failed(measures):
    return measures["n_words"] < 50 or 100 * measures["n_repeat_words"] > 50 * measures["n_words"]


def gram_buckets(text, known={}):  # noqa: B006
    """Buckets of the words and pairs of words, one after the other."""
    words = WORD.findall(text or "")
    for w in words:
        if w not in known:
            known[w] = word_hash(w)
    hashes = [known[w] for w in words]
    out = [int(h) % quality.BUCKETS for h in hashes]
    for pair in zip(hashes, hashes[1:]):
        run, _ = windows(np.array(pair, dtype=np.uint64), np.array([0, 2]), 2)
        out.append(int(run[0]) % quality.BUCKETS)
    return out


def quality_rows(docs, trusted, calibrating):
    """doc_id -> measures, llr, kept; `docs` are (doc_id, text)."""
    raw, target, grams = Counter(), Counter(), {}
    for i, text in docs:
        grams[i] = gram_buckets(text)
        raw.update(grams[i])
        if i in trusted:
            target.update(grams[i])
    raw_total = sum(raw.values()) + quality.BUCKETS
    weight = quality.PRIOR * quality.BUCKETS
    target_total = sum(target.values()) + weight

    def ratio(b):
        share = (raw[b] + 1) / raw_total
        return math.log((target[b] + weight * share) / target_total / share)

    out = {}
    for i, text in docs:
        found = base_measures(text)
        found["base_failed"] = base_failed(found)
        found["llr"] = sum(map(ratio, grams[i])) / max(len(grams[i]), 1)
        out[i] = found
    seen = sorted(out[i]["llr"] for i in out if i in calibrating and not out[i]["base_failed"])
    low = float(np.quantile(seen, quality.QUANTILE)) - quality.MARGIN if seen else -math.inf
    for found in out.values():
        found["kept"] = not found["base_failed"] and found["llr"] >= low
    return out


# Secrets


BASE = {
    "assign": (
        re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""),
        6,
    ),
    "access": (re.compile(r"()(AKIA[A-Z0-9]+)"), 20),
    "hex": (re.compile(r"()([0-9a-f]+)"), 24),
}


def secret_parts(text):
    """(kind, begin, end) of the strong parts, and of the weak ones that others complete."""
    text = text or ""
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    parts = []
    for kind in secrets.KINDS:
        pattern, least = BASE[kind] if kind in BASE else (re.compile(secrets.WEAK[kind][0]), secrets.WEAK[kind][1])
        parts += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[2]) >= least]

    def scope(at):
        return sum(b <= at for b in breaks)

    def complete(kind, begin):
        near = {
            secrets.ROLE[k]
            for k, b, _ in parts
            if scope(b) == scope(begin)
        } - {secrets.ROLE[kind]}
        return set(secrets.NEEDS[kind]) <= near

    found = [p for p in parts if p[0] in BASE or complete(p[0], p[1])]
    return sorted(found, key=lambda p: (p[1], secrets.KINDS.index(p[0])))


def listed(parts):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in parts)


def redacted(text, mark="[REDACTED]"):
    merged = []
    for _, a, b in sorted(secret_parts(text), key=lambda p: p[1:]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + mark + text[b:]
    return text


# Language model

END = None


def tokens_of(text):
    return [*WORD.findall((text or "").translate(FOLD)), END]


def unigram_scores(docs, held_out):
    """doc_id -> n_tokens, n_known, base_score; and the number of training tokens."""
    counts = Counter(t for i, text in docs if not held_out(i) for t in tokens_of(text))
    total = sum(counts.values())
    out = {}
    for i, text in docs:
        own = tokens_of(text)
        score = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        out[i] = (len(own), sum(counts[t] > 0 for t in own), score)
    return out, total


def class_scores(docs, class_of, prior):
    """doc_id -> log10 probability by class bigrams; every token has a class; learns from all docs."""
    moves, leaving, counts, sizes = Counter(), Counter(), Counter(), Counter()
    for _, text in docs:
        before = END
        for t in tokens_of(text):
            moves[class_of[before], class_of[t]] += 1
            leaving[class_of[before]] += 1
            counts[t] += 1
            sizes[class_of[t]] += 1
            before = t
    of_classes = max(class_of.values()) + 1
    out = defaultdict(float)
    for i, text in docs:
        before = END
        for t in tokens_of(text):
            a, b = class_of[before], class_of[t]
            out[i] += math.log10((moves[a, b] + prior) / (leaving[a] + prior * of_classes))
            out[i] += math.log10(counts[t] / sizes[b])
            before = t
    return out
