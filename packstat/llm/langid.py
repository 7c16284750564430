"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a linear classifier over hashed byte n-grams of the
whole text tells which half of the languages the text belongs to. Decoding adds up each bit's
logistic loss against a codeword, weighted by how well that bit did on the learning sample, and
takes the nearest codeword. A text whose two nearest codewords are close is flagged as ambiguous.

Classifiers are fitted on a bounded sample (``per_language`` rows a language), one task a bit;
every text is read whole for prediction. Null texts and texts without a letter are ``und`` with
score 0, as is everything when there is nothing to learn from. Rows that repeat an id are judged
separately. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.llm.common import texts
from packstat.session import checkpoint

#: Hashed n-grams, and labelled rows of each language that are learnt from.
WIDTH, PER_LANGUAGE = 1 << 12, 400
#: Below this gap between the two best scores a text is ambiguous.
MARGIN = 0.2
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:127] = 32  # all that is no letter counts as a gap


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1: all different halvings for few classes, else random columns with the best least distance."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [[1 if (bits >> c) & 1 else -1 for c in range(classes)] for bits in range(1, 2 ** (classes - 1))]
        return np.array(columns, float).T
    best, far, rng = None, -1, np.random.default_rng(classes)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, 10 * int(np.ceil(np.log2(classes)))))
        least = min((code[i] != code[j]).sum() for i in range(classes) for j in range(i))
        if least > far and (np.abs(code.sum(axis=0)) < classes).all():
            best, far = code, least
    return best


def features(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Root-scaled shares of hashed byte trigrams and bigrams, a row for each text, of length one."""
    n, docs = len(data), len(bounds) - 1
    if not n:
        return np.zeros((docs, width), np.float32)
    x = _FOLD[data]
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    out = np.zeros(docs * width, np.float32)
    for span, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if n < span:
            continue
        gram = x[: n - span + 1].copy()
        for j in range(1, span):
            gram = gram * np.uint32(257) + x[j: n - span + 1 + j]
        slot = ((gram * np.uint32(salt)) >> np.uint32(20)).astype(np.int64) % width
        inside = owner[: n - span + 1] == owner[span - 1:]
        out += np.bincount((owner[: n - span + 1] * width + slot)[inside], minlength=docs * width).astype(np.float32)
    out = np.sqrt(out.reshape(docs, width))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps: weights, and the weighted share of rows on the right side."""
    w = np.zeros(x.shape[1])
    ahead, step = w.copy(), 1.0
    for _ in range(rounds):
        pull = weight * y / (1.0 + np.exp(np.clip(y * (x @ ahead), -30, 30)))
        new = ahead + rate * (x.T @ pull - decay * ahead)
        following = (1 + (1 + 4 * step * step) ** 0.5) / 2
        ahead, w, step = new + (step - 1) / following * (new - w), new, following
    return w, float((weight * (y * (x @ w) > 0)).sum())


def _fit_bit(code: np.ndarray, names: list[str]):
    at = {name: i for i, name in enumerate(names)}

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        bit, text = int(frame["bit"].iloc[0]), frame["text"].tolist()
        frame = frame.reset_index(drop=True)
        chosen, parts = [], []
        for i, t in enumerate(text):  # whole texts, and a short stretch of each, so that short texts are known too
            raw = t.encode()
            middle = max(0, len(raw) // 2 - 30)
            parts += [raw, raw[middle: middle + 60]]
            chosen += [i, i]
        x = np.concatenate([features(np.frombuffer(b"".join(parts[j: j + 128]), np.uint8),
                                     np.cumsum([0, *map(len, parts[j: j + 128])])) for j in range(0, len(parts), 128)]).astype(np.float64)
        label = np.array([at[frame["lang"][i]] for i in chosen])
        share = 1.0 / np.bincount(label, minlength=len(names))[label] / len(set(label.tolist()))
        w, right = fit(x, code[label, bit], share)
        return pd.DataFrame({"bit": [bit], "weights": [w.astype("<f8").tobytes()], "right": [right]})
    return fitted


def learn(rows: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """Languages, codewords, weights of each bit's classifier, and the say of each bit."""
    known = rows.filter(F.col(label).isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("_order", F.xxhash64("doc_id", F.length("text")))
    first = Window.partitionBy(label).orderBy("_order", "doc_id")
    ids = known.select("doc_id", label, "_order").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language)
    ids = checkpoint(ids.select(F.col("doc_id").alias("_doc"), F.col("_order").alias("_at")))
    sample = checkpoint(known.join(ids, (F.col("doc_id") == F.col("_doc")) & (F.col("_order") == F.col("_at"))).select(F.col(label).alias("lang"), "text"))
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not names:
        return None
    code = codewords(len(names))
    bits = sample.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(code.shape[1] - 1))))
    fits = sorted(bits.groupBy("bit").applyInPandas(_fit_bit(code, names), "bit int, weights binary, right double").collect(), key=lambda r: r["bit"])
    weights = np.stack([np.frombuffer(r["weights"], "<f8") for r in fits], axis=1).astype(np.float32)
    say = np.array([max(0.05, 2 * r["right"] - 1) for r in fits])
    return names, code, weights, say / say.sum()


def _predict(model):
    names, code, weights, say = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, doubt = [], [], []
            column = batch.column("text")
            for i, j, data, bounds in texts(column, 1 << 19):
                for a in range(0, j - i, 256):
                    part = bounds[a: a + 257]
                    margin = features(data[part[0]: part[-1]], part - part[0]) @ weights
                    loss = np.logaddexp(0.0, -margin[:, None, :] * code[None, :, :]) @ say
                    chance = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4.0)
                    chance /= chance.sum(axis=1, keepdims=True)
                    order = np.sort(chance, axis=1)
                    for k, text in enumerate(column.slice(i + a, len(part) - 1).to_pylist()):
                        seen = bool(text) and any(map(str.isalpha, text))
                        lang.append(names[int(chance[k].argmax())] if seen else "und")
                        score.append(float(order[k, -1]) if seen else 0.0)
                        doubt.append(seen and len(names) > 1 and bool(order[k, -1] - order[k, -2] < MARGIN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "ambiguous"])
    return predict


def identify(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; only rows that are not held out are learnt from."""
    model = learn(docs.filter(~F.coalesce(held_out, F.lit(True))), per_language=per_language)
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        out = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    else:
        out = rows.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
