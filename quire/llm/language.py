"""Language ID: multinomial naive Bayes over hashed character n-grams.

Text is folded to lower-case letters, everything else to a space; the n-grams
of 1 to 3 characters that hold a letter are hashed into ``BUCKETS``. Training
counts (language, bucket) per task and adds them up by partial aggregates. The
matrix of log-probabilities has a fixed width, so its size is languages x
``BUCKETS`` x 4 bytes, with at most ``MAX_LANGUAGES`` languages; that is what
is broadcast. A batch is scored as a sparse product: the matrix rows of all
its n-grams, summed per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import per_worker, quoted, table, without

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
CHUNK = 1 << 19      # characters vectorised at a time
UNKNOWN = "und"
#: Before, between and after texts: no n-gram holds letters of two texts, and
#: those that reach into a gap belong to the text whose letter they hold.
_GAP = " " * (max(ORDERS) - 1)


def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    def make():
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        return out
    return per_worker("language-fold", make)


def _chunks(texts):
    """(index of the first text, text parts): whole texts grouped to CHUNK
    characters; a longer text is one group."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, texts[start:]


def grams(texts: list[str]):
    """(codes, starts, buckets): ``starts`` are the texts' first positions; for
    each order, the bucket of the n-gram at each position (BUCKETS: none)."""
    joined = _GAP + _GAP.join(texts) + _GAP
    codes = _fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + len(_GAP))[:-1]])
    n = len(codes) - max(ORDERS) + 1
    letter = codes != 32
    out = []
    for order in ORDERS:
        h = np.full(n, (2166136261 * order) & 0xFFFFFFFF, np.uint32)
        some = np.zeros(n, bool)
        for k in range(order):
            h = (h ^ codes[k:n + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
            some |= letter[k:n + k]
        bucket = ((h * np.uint32(2654435769)) >> np.uint32(17)).astype(np.int32)
        bucket[~some] = BUCKETS
        out.append(bucket)
    return letter[:n], starts, out


def _count(batches):
    """(lang, text) -> (lang, bucket, n) summed per task; bucket -1 counts texts."""
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(counts[at])],
                names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        by = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            counts = held.setdefault(lang, np.zeros(BUCKETS + 2, np.int64))
            counts[0] += len(texts)
            for _, part in _chunks(texts):
                for bucket in grams(part)[2]:
                    counts[1:] += np.bincount(bucket, minlength=BUCKETS + 1)
            counts[-1] = 0
        if len(held) > 64:
            yield from flush()
    yield from flush()


class Model:
    """Languages (sorted), log-priors and log-probabilities, one row per bucket."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = SMOOTHING):
        self.languages = sorted(counts["lang"].unique())
        at = {lang: i for i, lang in enumerate(self.languages)}
        full = np.zeros((BUCKETS + 1, len(self.languages)))
        full[counts["bucket"].to_numpy(), counts["lang"].map(at).to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
        texts, full = full[-1].copy(), full[:-1]  # bucket -1 is the last row
        self.prior = np.log(texts / max(texts.sum(), 1.0)) if len(texts) else texts
        logp = np.log((full + smoothing) / (full.sum(0) + smoothing * BUCKETS))
        self.logp = np.vstack([logp, np.zeros((1, len(self.languages)))]).astype(np.float32)

    def predict(self, texts: list[str]):
        return classify(self.languages, self.prior, self.logp, texts)


def classify(languages, prior, logp, texts: list[str]):
    """(language, posterior) per text; 'und' and 0 without a letter or model."""
    names = np.full(len(texts), UNKNOWN, object)
    score = np.zeros(len(texts))
    if not languages:
        return names, score
    for first, part in _chunks(texts):
        letter, starts, buckets = grams(part)
        total = np.add.reduceat(logp[buckets[0]], starts, axis=0, dtype=np.float64)
        for b in buckets[1:]:
            total += np.add.reduceat(logp[b], starts, axis=0, dtype=np.float64)
        total += prior
        some = np.add.reduceat(letter.astype(np.int64), starts) > 0
        best = total.argmax(1)
        sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        rows = first + np.flatnonzero(some)
        names[rows] = np.array(languages, object)[best[some]]
        score[rows] = sure[some]
    return names, score


def train(labelled: DataFrame, max_languages: int = MAX_LANGUAGES) -> Model:
    """Model of ``labelled`` (lang, text), counted over all of its rows."""
    counts = (labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
              .mapInArrow(_count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = labelled.where("lang IS NOT NULL").select("lang").distinct().limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages: the broadcast matrix would pass its bound")
    return Model(counts.toPandas())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus lang_pred and score (posterior, 0 to 1); input columns of
    these names are replaced.

    Texts that are null or have no letter give 'und' and 0, and so does a
    model without languages. Ties go to the first language by code point.
    """
    # Plain arrays: a broadcast class would have to be importable on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.logp))

    def run(texts: pd.Series) -> pd.DataFrame:
        names, score = classify(*shared.value, [t or "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": score})

    out = F.pandas_udf(run, "lang_pred string, score double")
    cols = without(docs, "lang_pred", "score", "__out")
    return docs.withColumn("__out", out("text")).select(*map(quoted, cols), "__out.lang_pred", "__out.score")


def held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
