"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Two multinomials over hashed n-grams are counted: the raw corpus (all documents) and the trusted target
(documents labelled good). N-grams are single words and pairs of neighbouring word shapes (runs of
capitals, small letters and digits as one sign each), so that words never met before still say how
they are written. A document's score is the mean over its n-grams of log p_target - log p_raw. Both are proper
distributions over the buckets: the raw one with added counts, the target one with the raw one as its Dirichlet
prior. Every document is compared with one threshold, fixed from the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import SPACE, settled, space_words

BUCKETS = 1 << 14
#: At most so many labelled documents of each kind are used: those with the smallest hash of their id.
SAMPLE, TRUSTED_PASS = 4000, 0.995
#: Count added to each raw bucket, and the prior's weight in the target as a share of the target's n-grams.
SMOOTHING, PRIOR = 0.5, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"


def _shape(text: Column) -> Column:
    """Runs of small letters (and of letters beyond ASCII), capitals and digits as one sign each."""
    for runs, sign in (("[a-z\\x{80}-\\x{10FFFF}]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        text = F.regexp_replace(text, runs, sign)
    return text


def with_words(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``id_col``, ``more``, _text, _shape and _words: 64-bit hashes of the text's words in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    frame = docs.select(F.col(id_col), *more, text.alias("_text"), _shape(text).alias("_shape"))
    return frame.withColumn("_words", F.transform(space_words(F.col("_text")), lambda w: F.xxhash64(w)))


def _grams(frame: DataFrame) -> DataFrame:
    """Adds _grams: the buckets of a document's words and of its pairs of neighbouring shapes."""
    frame = frame.withColumn("_shapes", space_words(F.col("_shape")))
    words = f"transform(_words, w -> CAST(pmod(w, {BUCKETS}) AS INT))"
    pairs = f"if(size(_shapes) > 1, transform(sequence(0, size(_shapes) - 2), i -> CAST(pmod(xxhash64(_shapes[i], _shapes[i + 1], 1), {BUCKETS}) AS INT)), CAST(array() AS ARRAY<INT>))"
    return frame.withColumn("_grams", F.expr(f"concat({words}, {pairs})"))


def base_columns(frame: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a ``with_words`` frame."""
    frame = frame.withColumn("n_words", F.size("_words").cast("long"))
    # White space and symbols are the same in the shape, which is a good deal shorter.
    frame = frame.withColumn("word_chars", (F.char_length("_text") - F.regexp_count("_shape", F.lit(f"[{SPACE}]"))).cast("long"))
    frame = frame.withColumn("n_symbols", F.regexp_count("_shape", F.lit(SYMBOLS)).cast("long"))
    frame = frame.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    frame = frame.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    frame = frame.withColumn("_h", F.expr("if(size(_words) >= 3, transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])), CAST(array() AS ARRAY<BIGINT>))"))
    # Only texts with a window found twice sort their windows; equal neighbours in that order are the repeated ones.
    frame = frame.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END")).drop("_h")
    repeated = "transform(filter(sequence(0, size(_s) - 1), k -> get(_s, k).h <=> get(_s, k - 1).h OR get(_s, k).h <=> get(_s, k + 1).h), k -> get(_s, k).i)"
    covered = f"size(array_distinct(flatten(transform({repeated}, i -> array(i, i + 1, i + 2)))))"
    frame = frame.withColumn("n_repeat_words", F.expr(f"CASE WHEN _s IS NULL THEN 0L ELSE CAST({covered} AS BIGINT) END")).drop("_s")
    return frame.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


@dataclass(frozen=True)
class Model:
    """Bucket weights log p_target - log p_raw and the least score that passes; no weights: all pass."""

    weights: tuple[float, ...] = ()
    threshold: float = 0.0

    def score(self) -> Column:
        """Mean weight of _grams; null for a document without n-grams."""
        listed = F.expr(f"CAST(split('{','.join(f'{w:.6g}' for w in self.weights)}', ',') AS ARRAY<DOUBLE>)")
        total = F.aggregate("_grams", F.lit(0.0), lambda sum_, g: sum_ + F.get(listed, g))
        return F.when(F.size("_grams") > 0, total / F.size("_grams"))


def _sample(labels: DataFrame, label_id: str, good: str) -> DataFrame:
    """(_labelled, _good): at most SAMPLE ids of each kind, by the smallest hash of the id."""
    kinds = []
    for value in (1, 0):
        ids = labels.where((F.col(good) == value) & F.col(label_id).isNotNull()).select(F.col(label_id).alias("_labelled"), F.lit(value == 1).alias("_good"))
        kinds.append(ids.distinct().orderBy(F.xxhash64(F.lit(11), "_labelled"), "_labelled").limit(SAMPLE))
    rows = kinds[0].unionByName(kinds[1]).collect()  # 2 * SAMPLE ids
    once = {}
    for r in sorted(rows):
        once.setdefault(r[0], r[1])  # an id with both labels counts as not trusted
    kind = labels.schema[label_id].dataType.simpleString()
    return labels.sparkSession.createDataFrame(list(once.items()), f"_labelled {kind}, _good boolean")


def distributions(raw: list[int], target: list[int]) -> tuple[list[float], list[float]]:
    """The two multinomials over the buckets; each sums up to one."""
    p_raw = [(r + SMOOTHING) / (sum(raw) + SMOOTHING * len(raw)) for r in raw]
    total, prior = sum(target), PRIOR * sum(target)
    return p_raw, [(t + prior * p) / (total + prior) for t, p in zip(target, p_raw)]


def ratio(raw: list[int], target: list[int]) -> tuple[float, ...]:
    """log p_target - log p_raw of each bucket."""
    return tuple(log(t / r) for r, t in zip(*distributions(raw, target)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", good: str = "quality") -> Model:
    """Count both multinomials (the raw one over all of ``docs``) and fix the threshold.

    The threshold is the highest that still passes TRUSTED_PASS of the trusted sample, moved halfway down
    towards the best score of the not trusted below it, or by a tenth of the trusted spread.
    """
    sample = F.broadcast(_sample(labels, label_id, good))
    marked = docs.select(id_col, text_col).join(sample, F.col(id_col) == F.col("_labelled"), "left")
    words = _grams(with_words(marked, id_col, text_col, "_good"))
    # explode_outer: from explode, Spark infers a filter that would make all n-grams a second time
    counts = words.select("_good", F.explode_outer("_grams").alias("g")).groupBy("g").agg(F.count("*").alias("raw"), F.count(F.when(F.col("_good"), 1)).alias("target")).where("g IS NOT NULL").collect()  # BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["g"]], target[r["g"]] = r["raw"], r["target"]
    if not sum(target):
        return Model()
    weights = ratio(raw, target)
    labelled = docs.select(id_col, text_col).join(sample, F.col(id_col) == F.col("_labelled"))
    # No filter here: it would be pushed into the scan, and each column it names made many times over.
    scored = base_columns(_grams(with_words(labelled, id_col, text_col, "_good"))).select(id_col, "_good", "base_failed", Model(weights).score().alias("score"))
    # One row for each id: of rows with the same id, however many, the least score counts.
    scored = scored.groupBy(id_col, "_good").agg(F.min(F.when(~F.col("base_failed"), F.col("score"))).alias("score")).collect()  # 2 * SAMPLE rows
    scored = [r for r in scored if r["score"] is not None]
    good_scores = sorted(r["score"] for r in scored if r["_good"])
    if not good_scores:
        return Model(weights, float("-inf"))
    least = good_scores[int((1 - TRUSTED_PASS) * len(good_scores))]
    below = [r["score"] for r in scored if not r["_good"] and r["score"] < least]
    spread = good_scores[len(good_scores) // 2] - least
    return Model(weights, (least + max(below)) / 2 if below else least - spread / 10)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    Null and empty texts have no words and fail the base rules. Repeated rows give repeated results.
    Without trusted documents only the base rules decide. Other columns are ignored; an empty table
    gives no rows.
    """
    frame = base_columns(_grams(with_words(docs, id_col, text_col)))
    score = model.score() if model.weights else F.lit(None).cast("double")
    passed = F.coalesce(F.col("score") >= F.lit(model.threshold), F.lit(True))
    columns = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return settled(frame.select(*columns, score.alias("score")).withColumn("kept", ~F.col("base_failed") & passed))


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, decided row by row without a shuffle."""
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text_col).alias("_t"))
    frame = base_columns(_grams(with_words(whole, "_row", "_t")))
    score = model.score() if model.weights else F.lit(None).cast("double")
    kept = ~F.col("base_failed") & F.coalesce(score >= F.lit(model.threshold), F.lit(True))
    rows = settled(frame.select("_row", kept.alias("_kept"))).where("_kept")
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns])
