"""Language identification with string kernels.

Blended-spectrum presence kernel: a text is the set of its character n-grams, n = 1 to 4 characters of the
lowered text with everything but letters and marks folded to one space; k(x, y) is the mean over n of
|S_n(x) & S_n(y)| / sqrt(|S_n(x)| |S_n(y)|). N-grams are hashed to a fixed number of slots per n. One-versus-rest kernel
ridge regression is fitted on a Nystroem approximation with landmark texts. Since the kernel is linear
in the presence vectors, the product of landmarks and ridge weights is taken once, and texts are scored
by one matrix product for each batch.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.llm.common import map_batches, texts_in

#: Bits of the slot table for n-grams of 1, 2, 3 and 4 characters.
BITS = (10, 13, 15, 16)
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
SLOTS = int(STARTS[-1])
#: The classifier is fitted on at most so many labelled texts of each language, and so many in all (but ``LEAST`` of
#: each language); of these so many of each, and in all (but one of each), are landmarks. All languages are learned.
FIT_PER_CLASS, FIT_TEXTS, LEAST, LANDMARKS_PER_CLASS, LANDMARKS, RIDGE = 300, 12_000, 10, 40, 400, 1e-2
HELD_OUT = 2
PIECE = 1 << 16


@functools.cache
def _codes() -> np.ndarray:
    """By code point: itself for letters and marks, else a space."""
    kept = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    return np.where(kept, np.arange(0x110000, dtype=np.uint32), np.uint32(32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str, row: np.ndarray) -> None:
    """Fill ``row`` (SLOTS zeros) with the normalised presence vector of a text."""
    codes = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    present = np.zeros(SLOTS, bool)
    for start in range(0, len(codes), PIECE):  # whole text, piece by piece, overlapping by three characters
        part = codes[start : start + PIECE + 3].astype(np.uint64)
        gram = np.zeros(len(part), np.uint64)
        for n, bits in enumerate(BITS):
            if len(part) <= n:
                break
            gram = gram[: len(part) - n] * np.uint64(0x110000) + part[n:]  # four code points need 81 bits: the highest ones wrap
            slot = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            present[STARTS[n] + slot.astype(np.int64)] = True
    for n in range(len(BITS)):
        inside = slice(STARTS[n], STARTS[n + 1])
        count = np.count_nonzero(present[inside])
        if count:
            row[inside][present[inside]] = 1 / np.sqrt(count * len(BITS))


def presences(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), SLOTS), np.float32)
    for text, row in zip(texts, rows):
        presence(text, row)
    return rows


class Model:
    """One-versus-rest kernel ridge regression on landmarks; ``weights`` maps presence vectors to scores."""

    def __init__(self, texts: list[str], langs: list[str], per_class: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE):
        self.classes = sorted(set(langs))
        place = {c: k for k, c in enumerate(self.classes)}
        labels = np.array([place[x] for x in langs], dtype=int)
        if not texts:
            self.weights = np.zeros((SLOTS, 0), np.float32)
            return
        per_class = max(1, min(per_class, LANDMARKS // len(self.classes)))
        chosen = np.concatenate([np.flatnonzero(labels == c)[:per_class] for c in range(len(self.classes))])
        landmarks = presences([texts[i] for i in chosen])
        size = np.bincount(labels, minlength=len(self.classes))[labels]
        balance = len(texts) / (len(self.classes) * size)  # classes count alike
        gram = ridge * len(texts) * ((landmarks @ landmarks.T).astype(np.float64) + 1e-6 * np.eye(len(chosen)))
        answer = np.zeros((len(chosen), len(self.classes)))
        for i in range(0, len(texts), 64):  # a few texts at a time
            near = (presences(texts[i : i + 64]) @ landmarks.T).astype(np.float64)
            weighted = near * balance[i : i + 64, None]
            gram += weighted.T @ near
            answer += weighted.T @ np.where(labels[i : i + 64, None] == np.arange(len(self.classes)), 1.0, -1.0)
        self.weights = (landmarks.T @ np.linalg.solve(gram, answer)).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text; ``und`` and 0 where it has no letter."""
        if not self.classes:
            return ["und"] * len(texts), [0.0] * len(texts)
        scores = presences(texts) @ self.weights
        best = scores.argmax(axis=1)
        odds = 1 / (1 + np.exp(-3.0 * scores.max(axis=1).astype(float)))
        letters = [has_letter(t) for t in texts]
        return [self.classes[b] if x else "und" for b, x in zip(best, letters)], [float(o) if x else 0.0 for o, x in zip(odds, letters)]


def remainder(id_col: str):
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = FIT_PER_CLASS, fit_texts: int = FIT_TEXTS) -> Model:
    """Fit on different labelled texts that are not held out: of each language those with the smallest hashes of the text.

    All languages are learned. The sample, which is all that reaches the driver, is at most ``per_class`` texts of a
    language and ``fit_texts`` in all (but ``LEAST`` of each language); repeated texts count once, so neither
    repeated rows nor repeated ids can flood or starve a language.
    """
    eligible = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (remainder(id_col) != HELD_OUT)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("place"))
    counts = eligible.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n"))
    langs = counts.count()
    if not langs:
        return Model([], [])
    per_class = max(min(per_class, LEAST), min(per_class, fit_texts // langs))
    # Texts below a hash that lets a few more than enough through; what is left is small, and ranked exactly.
    share = F.least(F.lit(1.0), F.lit(1.1 * per_class + 8 * per_class**0.5 + 8) / F.col("n"))
    near = eligible.join(F.broadcast(counts) if langs <= 10_000 else counts, "lang").where(F.pmod("place", F.lit(1 << 30)) < share * F.lit(1 << 30))
    ranked = near.dropDuplicates(["lang", "place"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place")))
    taken = sorted(ranked.where(F.col("rank") <= per_class).select("lang", "rank", "text").collect())
    return Model([r["text"] for r in taken], [r["lang"] for r in taken])


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, lang_pred, score) for every row of ``docs``, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every row if there is
    nothing to learn from. Repeated rows give repeated results; ties go to the language that sorts
    first. Other columns are ignored; an empty table gives no rows.
    """
    model = model or fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.classes))  # SLOTS floats a language

    def run(batches):
        scorer = Model([], [])
        scorer.weights, scorer.classes = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                langs, scores = scorer.predict([x.decode("utf-8", "replace") for x in texts_in(part.column(2))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, (remainder(id_col) == HELD_OUT).alias("held_out"), F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
