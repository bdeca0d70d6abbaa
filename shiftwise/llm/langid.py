"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text becomes the hashed counts of its letter n-grams (1 to 3). The mean of their embeddings goes through a linear
softmax. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, with
weight decay; every language is learned. One more class, never predicted, stands for what no language is: texts whose letters were
exchanged by a random substitution, half of them into other scripts. A fifth of each language's sample is left out of training: it
stops the training, fits the temperature of the probabilities and sets the score below which a prediction is rejected (languages with
too few documents are only learned). The model (``BINS * DIM`` floats) is of a fixed size; every text is scored whole, in tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.llm.words import tidy

BINS, DIM = 1 << 13, 16
DOCS_PER_LANG = 400  # sampled documents per language, by hash
DOCS_IN_ALL = 20_000  # sampled documents, about; with many languages each gets fewer, but not below one
PIECE = 1 << 20
UNKNOWN = "und"
ADDED = ("lang_pred", "lang_score", "lang_rejected")
NOISE = ""  # class of what is no language
TRAIN_LEAST = 5  # documents a language keeps for training before any is left out


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams, scaled to sum 1; None for a text without letters."""
    counts = np.zeros(BINS)
    found = False
    text = f" {text.lower()} "
    for at in range(0, len(text), PIECE):  # n-grams count where they start
        code = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters()[code]
        if not is_letter.any():
            continue
        c = np.where(is_letter, code, 0)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:]
        found = found or bool(is_letter[:PIECE].any())
        for grams, kept, salt in (
            (c, is_letter, 1), (two, is_letter[:-1] | is_letter[1:], 2), (three, is_letter[1:-1], 3)
        ):
            mixed = (grams[:PIECE][kept[:PIECE]] + np.uint32(salt)) * np.uint32(0x27D4EB2F)
            counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x165667B1) >> np.uint32(32 - 13), minlength=BINS)
    return counts / counts.sum() if found else None


#: first letters of scripts to write noise in: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Georgian, Hangul, kana, Han
SCRIPTS = (0x61, 0xE0, 0x3B1, 0x430, 0x5D0, 0x628, 0x905, 0xE01, 0x10D0, 0xAC00, 0x3041, 0x4E00)


def noise(text: str, seed: int) -> str:
    """The text with its letters exchanged by a random substitution; odd seeds write in another script than Latin."""
    rng = np.random.default_rng(seed)
    own = sorted({c for c in text.lower() if c.isalpha()})
    first = SCRIPTS[rng.integers(2, len(SCRIPTS))] if seed % 2 else SCRIPTS[0]
    spread = 26 if first < 0x100 else 22 if first < 0xA00 else 200 if first >= 0x4E00 else 30
    new = first + rng.permutation(max(spread, len(own)))[: len(own)]
    return text.lower().translate({ord(c): int(n) for c, n in zip(own, new)})


def short_spans(text: str, n: int = 2) -> list[str]:
    """Short stretches from inside the text, so that the model also learns from little evidence."""
    words = text.split()
    out = []
    for i in range(n):
        size = 4 + 12 * i
        if len(words) > 2 * size:
            at = (len(words) // (n + 1)) * (i + 1)
            out.append(" ".join(words[at : at + size]))
    return out


class LanguageModel:
    def __init__(self, langs: list[str], embed: np.ndarray, weight: np.ndarray, bias: np.ndarray):
        self.langs, self.embed, self.weight, self.bias = langs, embed, weight, bias
        self.temperature, self.threshold = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.embed) @ self.weight + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


class Rows:
    """Sparse rows of counts, made dense a batch at a time."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), BINS), np.float32)
        for i, r in enumerate(at):
            out[i, self.rows[r]["bin"]] = self.rows[r]["share"]
        return out

    def logits(self, m: LanguageModel, at: np.ndarray) -> np.ndarray:
        parts = [m.logits(self.dense(at[lo : lo + 256])) for lo in range(0, len(at), 256)]
        return np.concatenate(parts) if parts else np.zeros((0, len(m.bias)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))


def train(langs: list[str], x: Rows, y: np.ndarray, held: np.ndarray, epochs: int = 12, rate: float = 1.0, decay: float = 2e-3, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over mini-batches of the rows not ``held``; the classes weigh alike, and weights decay. It ends early
    where an epoch doesn't lower the held-out loss."""
    rng = np.random.default_rng(seed)
    scale = 20.0  # averages of unit-size embeddings are small; the factor is kept inside the embeddings
    m = LanguageModel(langs, rng.normal(0, 0.1, (BINS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    m.weight = rng.normal(0, 0.1, m.weight.shape)
    learn, test = np.flatnonzero(~held), np.flatnonzero(held)
    share = np.bincount(y[learn], minlength=len(langs))
    each = len(learn) / np.maximum(share, 1) / max(1, (share > 0).sum())
    again = np.maximum(1, each).astype(np.int64)  # rows of rare classes come repeatedly: as one heavy row each they'd make steps that diverge
    each = each / again
    pool = np.repeat(learn, again[y[learn]])
    batch, steps = 32, 0
    total = epochs * -(-len(pool) // batch)
    best = np.inf
    for _ in range(epochs):
        order = pool[rng.permutation(len(pool))]
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb = x.dense(rows) * scale
            hidden = xb @ m.embed
            z = hidden @ m.weight + m.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= each[y[rows]][:, None] / len(rows)
            step = rate * (1 - steps / total)
            back = p @ m.weight.T
            m.weight -= step * (hidden.T @ p + decay * m.weight)
            m.bias -= step * p.sum(axis=0)
            m.embed -= step * (xb.T @ back)
            m.embed *= 1 - step * decay
            steps += 1
        if len(test):
            z = x.logits(LanguageModel(langs, m.embed * scale, m.weight, m.bias), test)
            now = log_loss(z, y[test])
            if now > best:
                break
            best = now
    m.embed *= scale
    return m


def calibrate(m: LanguageModel, z: np.ndarray, y: np.ndarray, whole: np.ndarray, lost: float = 0.001) -> LanguageModel:
    """Temperature with the smallest held-out log loss, and the score below which predictions are rejected.

    ``z`` are the held-out logits, noise and short spans among them. The loss is convex in 1/T, so the temperature is found by
    halving, without an edge; rows that all are right would have it fall without end, so one wrong row of their mean
    logits is added. The threshold lies between what rightly predicted whole texts reach but for a share of ``lost`` and what wrong texts
    and noise reach but for the same share, in the middle of their log-odds; where these cross, the first counts.
    """
    if len(y) == 0:
        return m
    wrong = np.bincount(z.argmax(axis=1), minlength=z.shape[1]).argmin()
    zz, yy = np.vstack([z, z[z.argmax(axis=1) != wrong].mean(axis=0)]), np.append(y, wrong)

    def slope(b: float) -> float:
        s = zz * b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return float(((p * zz).sum(axis=1) - zz[np.arange(len(yy)), yy]).mean())

    low, high = 1.0, 1.0
    while slope(low) > 0 and low > 1e-12:
        low /= 2
    while slope(high) < 0 and high < 1e12:
        high *= 2
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (low, middle) if slope(middle) > 0 else (middle, high)
    m.temperature = (low * high) ** -0.5
    learned = np.array([n != NOISE for n in m.langs])
    s = z / m.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True)) * learned
    best = p.max(axis=1)
    right = p.argmax(axis=1) == y
    sound, bad = best[right & whole], best[~right]
    odds = lambda v: np.log(max(v, 1e-15) / max(1 - v, 1e-15))
    if len(sound):
        reached = np.quantile(sound, lost, method="lower")
        least = np.quantile(bad, 1 - lost, method="higher") if len(bad) else 0.5 * reached
        m.threshold = float(1 / (1 + np.exp(-(odds(reached) + odds(least)) / 2)) if least < reached else reached)
    return m


SPARSE = np.dtype([("bin", "<u2"), ("share", "<f4")])
SAMPLE = "lang string, fold long, whole boolean, x binary"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, docs_in_all: int = DOCS_IN_ALL) -> LanguageModel | None:
    """Model learned from about ``docs_per_lang`` hash-chosen rows of each language, ``docs_in_all`` together (but one of each language at
    least); None if there is nothing to learn from.

    Only the number of languages and the sample's features (some KB a row, 48 at most, kept sparse) reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(11), F.struct(key)).alias("h")
    )
    draw = F.struct(F.pmod("h", F.lit(1 << 30)).alias("draw"), "h")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first"))
    n = counts.count()
    if not n:
        return None
    share = min(docs_per_lang, max(1, docs_in_all // n)) / F.col("n")
    drawn = F.pmod("h", F.lit(1 << 30))
    # One row per language: no more than the model, which the driver holds as well. So no text is shuffled.
    chosen = rows.join(F.broadcast(counts), "lang").where((drawn / float(1 << 30) < share) | (drawn <= F.col("first.draw"))).select("lang", "text", "h")

    def features(batches):
        for batch in batches:
            out = []
            for name, t, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h"))):
                spans = short_spans(t)
                for k, (of, part) in enumerate([(name, t), *((name, p) for p in spans), (NOISE, noise((spans or [t])[-1][:2000], h % (1 << 32)))]):
                    x = subwords(part)
                    if x is not None:
                        filled = np.zeros(np.count_nonzero(x), SPARSE)
                        filled["bin"], filled["share"] = np.flatnonzero(x), x[x > 0]
                        out.append((of, (h >> 32) % 5, k == 0, filled.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.binary()))],
                    names=["lang", "fold", "whole", "x"],
                )

    got = sorted(chosen.mapInArrow(tidy(features), SAMPLE).collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    place = {name: i for i, name in enumerate(langs)}
    y = np.array([place[r["lang"]] for r in got])
    held, whole = np.array([r["fold"] == 0 for r in got]), np.array([r["whole"] for r in got])
    x = Rows([np.frombuffer(r["x"], SPARSE) for r in got])
    del got
    learned = np.bincount(y[~held & whole], minlength=len(langs))
    held &= (learned[y] >= TRAIN_LEAST) | (np.array([n == NOISE for n in langs])[y])  # of a small language all rows are learned
    model = train(langs, x, y, held)
    return calibrate(model, x.logits(model, np.flatnonzero(held)), y[held], whole[held])


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """``keep`` (default: all columns) plus ``names``: predicted language, score, and whether it is rejected.

    A null text or one without letters is ``und`` with score 0 and rejected; so is every text if there is no model. Other texts
    get a learned language, the calibrated probability, and are rejected below the model's threshold. Only the text is looked
    at. An empty table gives no rows; repeated rows are predicted alike. A kept column of one of the added names is left out.
    """
    kept = [c for c in df.columns if c.lower() not in names] if keep is None else keep
    inner = [f"_k{i}" for i in range(len(kept))]  # clashing names don't matter inside
    slim = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner)], *([] if text in kept else [F.col(text).alias("_text")]))
    read = inner[kept.index(text)] if text in kept else "_text"  # a text travels once

    learned = np.array([n != NOISE for n in model.langs]) if model is not None else None

    def predict(batches):
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            pred, score, rejected = [], [], []
            for value in batch.column(read):
                t = value.as_py()
                x = subwords(t) if t and model is not None else None
                if x is None:
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                p = model.probabilities(x) * learned
                best = int(np.argmax(p))
                pred.append(model.langs[best]), score.append(float(p[best])), rejected.append(bool(p[best] < model.threshold))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in inner), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*inner, *ADDED],
            )

    fields = [T.StructField(n, slim.schema[n].dataType) for n in inner]
    extra = [T.StructField(n, t) for n, t in zip(ADDED, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    out = slim.mapInArrow(tidy(predict), T.StructType([*fields, *extra]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, inner)], *[F.col(a).alias(n) for a, n in zip(ADDED, names)])


def fold(key: str, parts: int, which: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == which, F.lit(False))


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold("doc_id", 4, 2)
    model = fit(docs.where(~held & F.col("doc_id").isNotNull()))
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
