"""Language of whole texts: first the family, then the language within it.

Features are hashed byte n-grams of one to three of the case-folded text with everything in ASCII
but letters as blanks; their square roots, scaled to length one. Families are told apart by
one-versus-one linear support vector machines, and so are the languages of each family; each machine
is trained in a task of its own. Every machine sees at most `SAMPLE` texts of each side, drawn by
hashed id: this bounds training whatever the corpus, and is the only sampling.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.text import Texts, slices

SAMPLE = 500
DIMENSIONS = 4096
EPOCHS = 30
COST = 10.0
#: Texts whose features are held at a time, however short they are.
AT_ONCE = 256
UNKNOWN = "und"
# Families of languages. A language in none of them is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = ord(" ")
for _c in range(26):
    _CLEAN[ord("a") + _c] = _CLEAN[ord("A") + _c] = ord("a") + _c


def features(texts: Texts) -> np.ndarray:
    """One row of `DIMENSIONS` features and a constant for each text."""
    out = np.empty((len(texts), DIMENSIONS + 1), dtype=np.float32)
    data = _CLEAN[texts.data].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.bounds))
    counts = np.zeros(len(texts) * DIMENSIONS)
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 4):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        bucket = ((code + np.uint32(n << 28)) * np.uint32(2654435761)) >> np.uint32(20)
        within = owner[n - 1 :] == owner[: len(code)]
        counts += np.bincount(
            owner[: len(code)][within] * DIMENSIONS + bucket[within], minlength=len(counts)
        )
    rows = np.sqrt(counts).reshape(len(texts), DIMENSIONS)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    out[:, :-1] = rows / np.maximum(norm, 1e-9)
    out[:, -1] = 1.0
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch, most=AT_ONCE):
            rows = [row.tobytes() for row in features(texts)]
            yield texts.batch.drop_columns("text").append_column("x", pa.array(rows, pa.binary()))


def separate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine for labels 1 and -1: squared hinge loss by dual descent."""
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    size = (x * x).sum(axis=1) + 0.5 / COST
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            slope = y[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / COST
            new = max(alpha[i] - slope / size[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["label", "draw"])
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), -1).astype(float)
    y = np.where(rows["label"] == rows["one"], 1.0, -1.0)
    first = rows.iloc[0]
    return pd.DataFrame({"one": [first["one"]], "other": [first["other"]], "w": [separate(x, y).tobytes()]})


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _sampled(labelled: DataFrame, counts: dict[str, int], bound: int) -> DataFrame:
    """At most `bound` rows of each label, drawn by hashed id; about twice as many are looked at."""
    share = F.create_map(
        *[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2.0 * bound / n))]
    )
    draw = F.xxhash64(F.lit(7), "doc_id", "text")
    drawn = labelled.withColumn("draw", draw).filter(
        F.pmod(F.col("draw"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)
    )
    first = Window.partitionBy("label").orderBy("draw")
    return drawn.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= bound)


def _machines(labelled: DataFrame, counts: dict[str, int], groups: list[list[str]], bound: int):
    """(one, other) -> weights for each two labels of each group."""
    pairs = [p for labels in groups for p in combinations(sorted(labels), 2)]
    if not pairs:
        return {}
    x = _sampled(labelled, counts, bound).select("label", "draw", "text").mapInArrow(
        _featured, "label string, draw long, x binary"
    )
    sides = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("other")) for a, b in pairs])
    tasks = x.withColumn("pair", F.explode(sides)).filter(
        (F.col("label") == F.col("pair.one")) | (F.col("label") == F.col("pair.other"))
    )
    trained = (
        tasks.select("label", "draw", "x", "pair.one", "pair.other")
        .groupBy("one", "other")
        .applyInPandas(_train, "one string, other string, w binary")
        .collect()
    )
    return {(r["one"], r["other"]): np.frombuffer(r["w"]) for r in trained}


def _votes(x: np.ndarray, labels: list[str], machines) -> np.ndarray:
    """Share of belief in each label: its sums of squashed margins over the others', scaled."""
    if len(labels) == 1:
        return np.ones((len(x), 1))
    total = np.zeros((len(x), len(labels)))
    for (i, a), (j, b) in combinations(enumerate(labels), 2):
        belief = 1 / (1 + np.exp(-4 * np.clip(x @ machines[a, b], -8, 8)))
        total[:, i] += belief
        total[:, j] += 1 - belief
    return total / total.sum(axis=1, keepdims=True)


def _predictor(families: dict[str, list[str]], machines):
    names = sorted(families)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch, most=AT_ONCE):
                x = features(texts).astype(float)
                of_family = _votes(x, names, machines)
                best = of_family.argmax(axis=1)
                lang = np.empty(len(texts), dtype=object)
                score = of_family.max(axis=1)
                for f, name in enumerate(names):
                    rows = np.flatnonzero(best == f)
                    inner = _votes(x[rows], families[name], machines)
                    lang[rows] = np.array(families[name], dtype=object)[inner.argmax(axis=1)]
                    score[rows] *= inner.max(axis=1)
                out = texts.batch.drop_columns("text")
                out = out.append_column("lang_pred", pa.array(list(lang), pa.string()))
                yield out.append_column("score", pa.array(score))

    return predict


def predicted_languages(documents: DataFrame, held_out: Column, bound: int = SAMPLE) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, lang_pred and score.

    Learns from text and non-null lang of the rows that are not `held_out`; a prediction reads the
    text alone. A text that is null or has no letter is `und` with score 0, and so is every text if
    nothing is labelled. Ties go to the label first in the alphabet. Rows without id and repeated
    rows are predicted like any other; a null `held_out` (of a null id) is false. An empty table has
    no predictions. Texts of any length are read whole, one at a time if they are long. Other
    columns are not read.
    """
    rows = documents.select(
        "doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    learned = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & has_letter)
    counts = {r["lang"]: r["n"] for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    output = ["doc_id", "held_out"]
    if not counts:
        return rows.select(
            *output, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    families: dict[str, list[str]] = {}
    for lang in sorted(counts):
        families.setdefault(f"family {family_of(lang)}", []).append(lang)
    family = F.create_map(*[F.lit(v) for f, ls in families.items() for lang in ls for v in (lang, f)])
    of_family = {f: sum(counts[lang] for lang in ls) for f, ls in families.items()}
    text = learned.select("doc_id", "text", "lang")
    machines = _machines(
        text.withColumn("label", family[F.col("lang")]), of_family, [list(families)], bound
    ) | _machines(text.withColumn("label", F.col("lang")), counts, list(families.values()), bound)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    predicted = rows.select(*output, has_letter.alias("has_letter"), "text").mapInArrow(
        _predictor(families, machines),
        f"doc_id {id_type}, held_out boolean, has_letter boolean, lang_pred string, score double",
    )
    return predicted.select(
        *output,
        F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"),
    )
