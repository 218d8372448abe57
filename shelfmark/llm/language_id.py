"""Language identification with a convolutional network over bytes.

The network reads windows of a fixed number of bytes: each byte has a learned vector, filters of several widths slide
over them, the largest response of each filter in the window is kept, and a softmax layer over those names the
language. It is trained in numpy on a bounded sample of labelled texts. A text of any length is read whole, as windows
that follow one another; its windows' probabilities are averaged by their bytes, so that the score of a text in two
languages is about the share of the one it is named by. Filters reach over a window's edge
into the next bytes of the text only within the window, so each window counts by itself.

The model is a few tens of kilobytes, whatever the corpus; it goes to the tasks with their code. Texts are judged
where they are: nothing is shuffled. Each step works on a bounded number of windows, so memory does not grow with a text.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text when there is nothing to
learn from; with one language learned every other text is that language with score 1. A null id is never held out of
prediction; it takes no part in learning. Rows with null text or language teach nothing. Repeated rows are judged
alike. An empty table gives an empty one. Of equally likely languages the first by name wins. Only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.ranking import numbered
from shelfmark.session import checkpointed

#: Bytes of a window; windows follow one another.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: At most this many labelled texts are learned from, an equal share of each language, and this many letters of each.
SAMPLE_ROWS = 4000
SAMPLE_LETTERS = 1024
#: Rows of a language that are ranked by digest, as a multiple of its share.
SPARE = 4
#: Rarer languages than this many are not learned.
MAX_LANGUAGES = 200
EPOCHS = 8
UNKNOWN = "und"
#: A text is in no language if more than this share of it is judged so.
MAJORITY = 0.5
#: Of so many held-out labelled texts one at most may be judged to be in no language.
REJECTED = 1000
#: Code points of the scripts that texts in no language are drawn from.
SCRIPTS = [(0x61, 0x7B), (0xE0, 0x17F), (0x3B1, 0x3CA), (0x410, 0x450), (0x5D0, 0x5EB), (0x621, 0x64B), (0x905, 0x93A), (0xE01, 0xE2F),
           (0x3041, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A4)]


@dataclass
class Model:
    """languages in order of name; bytes' vectors (row 256 is the padding), filters as one matrix, softmax layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: bytes) -> np.ndarray:
    """A text's bytes as rows of WINDOW, the last one padded."""
    n = -(-len(data) // WINDOW)
    rows = np.full(n * WINDOW, 256, dtype=np.int16)
    rows[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return rows.reshape(n, WINDOW)


def _gathered(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The vectors of each place and of those behind it, as many as the widest filter: (places, width * size)."""
    wide = max(WIDTHS)
    padded = np.concatenate([rows, np.full((len(rows), wide - 1), 256, rows.dtype)], axis=1)
    x = vectors[padded]
    n, length, size = x.shape
    steps = np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * size), (x.strides[0], x.strides[1], x.strides[2]))
    return np.ascontiguousarray(steps).reshape(-1, wide * size)


def _mask() -> np.ndarray:
    """Narrower filters have no weight on the places behind their width."""
    mask = np.zeros((max(WIDTHS) * EMBEDDING, len(WIDTHS) * FILTERS), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask


def log_probabilities(model: Model, rows: np.ndarray) -> np.ndarray:
    response = (_gathered(model.vectors, rows) @ model.filters).reshape(len(rows), WINDOW, -1).max(axis=1)
    scores = np.maximum(response + model.bias, 0) @ model.out + model.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.003, batch: int = 64, seed: int = 0) -> Model:
    """Adam on the cross entropy of windows; the gradient of a maximum goes to the place that had it."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    cut = [windows(t.encode("utf-8", "replace")) for t in texts]
    rows = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.int16)
    goal = np.repeat([languages.index(x) for x in labels], [len(c) for c in cut]).astype(np.int64)
    wide, n_filters = max(WIDTHS), len(WIDTHS) * FILTERS
    vectors = rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
    vectors[256] = 0
    mask = _mask()
    filters = (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32)
    out = rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32)
    values = [vectors, filters, np.zeros(n_filters, np.float32), out, np.zeros(len(languages), np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            pick = order[start:start + batch]
            vectors, filters, bias, out, out_bias = values
            x, n = rows[pick], len(pick)
            places = _gathered(vectors, x)
            response = (places @ filters).reshape(n, WINDOW, n_filters)
            best = response.argmax(axis=1)
            pooled = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + bias
            active = np.maximum(pooled, 0)
            scores = active @ out + out_bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            d_scores = scores / scores.sum(axis=1, keepdims=True)
            d_scores[np.arange(n), goal[pick]] -= 1
            d_scores /= n
            d_pooled = (d_scores @ out.T) * (pooled > 0)
            chosen = places[(np.arange(n)[:, None] * WINDOW + best).ravel()].reshape(n, n_filters, -1)
            d_filters = np.einsum("nfe,nf->ef", chosen, d_pooled) * mask
            d_places = (d_pooled[:, :, None] * filters.T[None]).reshape(n, n_filters, wide, EMBEDDING)
            padded = np.concatenate([x, np.full((n, wide - 1), 256, x.dtype)], axis=1)
            at = np.take_along_axis(padded, (best[:, :, None] + np.arange(wide)).reshape(n, -1), 1)
            d_vectors = np.zeros_like(vectors)
            np.add.at(d_vectors, at.ravel(), d_places.reshape(-1, EMBEDDING))
            d_vectors[256] = 0
            step += 1
            grads = [d_vectors, d_filters, d_pooled.sum(axis=0), active.T @ d_scores, d_scores.sum(axis=0)]
            for value, grad, (first, second) in zip(values, grads, moments):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(languages, *values)


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts: an equal share of each language, chosen by digest; of long texts a stretch.

    Rows whose digest is small enough for their language are a few times its share; only those are ranked.
    """
    named = labelled.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
    found = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return [], []
    share = max(1, rows // len(found))
    limit = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1 << 20, math.ceil(SPARE * share / r["count"] * (1 << 20))))])
    few = named.where(F.shiftrightunsigned("h", 44) < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(0)))
    start = F.expr(f"1 + pmod(h, greatest(1, length(t) - {SAMPLE_LETTERS}))")
    ranked = few.select("lang", "h", F.substring("t", start, F.lit(SAMPLE_LETTERS)).alias("t")).withColumn(
        "r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t")))
    chosen = sorted((r["lang"], r["t"]) for r in ranked.where(F.col("r") <= share).select("lang", "t").collect())
    return [t for _, t in chosen], [lang for lang, _ in chosen]


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of learning: the crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS,
        background: bool = False) -> Model | None:
    """A model of the labelled rows that are not held out; None if there are none. With a background, one more class, `und`,
    is learned from texts in no language, as many as a language has on average."""
    texts, labels = sample(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col, rows)
    if background and texts:
        texts = texts + no_language(max(64, len(texts) // len(set(labels))))
        labels = labels + [UNKNOWN] * (len(texts) - len(labels))
    return train(texts, labels) if texts else None


def no_language(n: int, seed: int = 1) -> list[str]:
    """n texts of characters drawn at random: words of one script (Latin ones with and without marks), strings of a byte
    encoding without blanks, and figures with signs. Letters of a script are drawn alike often, as no language has them."""
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(n):
        size = int(rng.integers(40, SAMPLE_LETTERS))
        kind = k % 8
        if kind < 4:
            letters = [chr(c) for c in range(*SCRIPTS[int(rng.integers(len(SCRIPTS)))])]
            letters = letters if kind else [chr(c) for c in [*range(97, 123), *range(0xE0, 0x17F)]]
            cut = rng.random(size) < rng.choice([0, 0.08, 0.18])
        elif kind < 6:
            letters, cut = [chr(c) for c in [*range(65, 91), *range(97, 123), *([*range(48, 58), 43, 47] if kind == 4 else [])]], rng.random(size) < rng.choice([0, 0.15])
        else:
            letters, cut = list("0123456789.,:;$%&*#@+-/()[]{}<>=|_" + "abcdefghijklmnopqrstuvwxyz"[:2 * (kind - 5)]), rng.random(size) < 0.15
        chosen = rng.choice(letters, size)
        texts.append("".join(np.where(cut, " ", chosen)))
    return texts


def classify(model: Model, data: list[bytes], step: int = 256) -> tuple[list[int], list[float]]:
    """The likeliest language of each text and its probability. Works on `step` windows at a time."""
    sizes = np.array([-(-len(d) // WINDOW) for d in data], dtype=np.int64)
    owner = np.repeat(np.arange(len(data)), sizes)
    total = np.zeros((len(data), len(model.languages)))
    weight = np.zeros(len(data))
    rows = np.concatenate([windows(d) for d in data]) if data else np.zeros((0, WINDOW), np.int16)
    for start in range(0, len(rows), step):
        piece, own = rows[start:start + step], owner[start:start + step]
        filled = (piece < 256).sum(axis=1)
        np.add.at(total, own, np.exp(log_probabilities(model, piece)) * filled[:, None])
        np.add.at(weight, own, filled)
    probability = total / np.maximum(weight, 1)[:, None]
    best = probability.argmax(axis=1)
    return best.tolist(), np.clip(probability[np.arange(len(data)), best], 0, 1).tolist()


def no_language_limit(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score above which `und` of a model with a background rejects a text: MAJORITY, or more where more than one in REJECTED
    of all held-out labelled texts would go. Every such text is judged whole; counts and one score come to the driver."""
    known = docs.where(held_out(id_col) & (F.col(lang_col).cast("string") != UNKNOWN) & F.col(text_col).rlike(r"\p{L}"))
    judged = checkpointed(predict(known, model, id_col, text_col).select("lang_pred", "score"))
    against = judged.where((F.col("lang_pred") == UNKNOWN) & (F.col("score") > MAJORITY))
    spared = judged.count() // REJECTED
    if against.count() <= spared:
        return MAJORITY
    return numbered(against.select("score"), [F.col("score").desc()], "n").where(F.col("n") == spared + 1).first()["score"]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred and score of every row, and the columns to carry along."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(F.col(id_col), F.when(letters, F.col(text_col)).alias("__text"), *carry)
    names = [id_col, *carry]
    fields = [f for f in narrow.schema if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                texts = piece.column(1).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                told = [i for i, t in enumerate(texts) if t is not None] if model else []
                for i, best, score in zip(told, *classify(model, [texts[i].encode("utf-8", "replace") for i in told]) if told else ((), ())):
                    langs[i], scores[i] = model.languages[best], score
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *piece.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return narrow.mapInArrow(run, schema)
