"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and everything but letters becomes one space, so that features are the 1- to 3-grams of words and
their borders, hashed to `2**BITS` bins. Fitting counts bins per language over about `per_lang` labelled documents of
each language (chosen by a hash of doc_id; the bound is the documented parameter). The log-probability matrix, of
languages x 2**BITS floats, is broadcast: at most `MAX_LANGS` languages, checked before anything is collected, so 64 MB.
Scoring is a gather and a segmented sum per language over whole texts.

Prediction reads the text alone. Result per row: lang_pred, the learned language with the largest sum of log prior and log
probabilities, or `und` with score 0 where the text is null or has no letter, or where nothing could be learned; score, the
posterior of the prediction with the logarithms of texts longer than `EVIDENCE` n-grams scaled down to that many: overlapping n-grams are
far from independent, so the plain posterior of any long text is 1; and per_gram, the mean log probability of an n-gram in that language.
Ties go to the language first in alphabetical order. Rows with a null doc_id are scored and never learned from, nor are rows with
a null lang; repeated rows each get a row; very long texts are read whole; an empty table gives none; extra columns are ignored.

The stage `filter_stage` rejects documents that are `und`, whose n-grams are hardly more likely in their best language than a uniform draw of bins (`FIT`), that are
undecided between languages, or whose label is a learned language and contradicts a sure prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K

BITS, GRAMS, EVIDENCE = 16, 3, 60
MAX_LANGS = 256
PER_LANG = 2500
#: Mean log probability of an n-gram drawn uniformly from the bins.
UNIFORM = -BITS * float(np.log(2))
#: Documents whose n-grams are not at least so likely, on average, in their best language are in none that is known.
FIT = UNIFORM + 1.0
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _alpha[0]


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n: the bins of all n-grams, and the first n-gram of each text with an end mark; and which texts have letters."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    first = np.r_[0, np.cumsum(sizes)]
    inner = first[1:-1]
    inner = inner[inner < len(code)]
    keep[inner] = letter[inner]
    total = np.r_[0, np.cumsum(keep)]
    bounds = total[first]
    char = np.where(letter, code, 32)[keep].astype(np.uint64)
    bins, starts = [], []
    h = np.zeros(len(char), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(char) - n + 1
        if m <= 0:
            bins.append(np.zeros(0, np.int64)), starts.append(np.zeros(len(bounds), np.int64))
            continue
        h = h[:m] * np.uint64(0x100000001B3) + (char[n - 1 :] + np.uint64(1))
        ok = np.ones(m, bool)
        for k in range(1, n):  # n-grams over the border of two texts
            cut = bounds[1:-1] - k
            ok[cut[(cut >= 0) & (cut < m)]] = False
        if n == 1:
            ok &= char != 32
        b = (K.mix(h * _SALT[n - 1] + _SALT[n - 1]) >> np.uint64(64 - BITS)).astype(np.int64)
        count = np.r_[0, np.cumsum(ok)]
        bins.append(b[ok])
        starts.append(count[np.minimum(bounds, m)])
    has = np.add.reduceat(np.r_[letter, False].astype(np.int64), np.minimum(first[:-1], len(code))) > 0 if len(texts) else np.zeros(0, bool)
    has &= sizes > 0
    return bins, starts, has


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over [starts[i], starts[i+1])."""
    out = np.zeros(len(starts) - 1)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], dtype=np.float64)
    return out


def _blocks(texts: list) -> Iterator[tuple[int, int]]:
    return K.chunks(np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), K.CHUNK >> 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for i, j in _blocks(own):
                for b in features(own[i:j])[0]:
                    sums[lang] = sums.get(lang, 0) + np.bincount(b, minlength=1 << BITS)
    for lang, v in sums.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at].astype(np.int64))], names=["lang", "bin", "n"])


def _row_of_log_probabilities(key: tuple, table: pa.Table) -> pa.Table:
    counts = np.full(1 << BITS, 0.5)
    np.add.at(counts, table.column("bin").to_numpy(), table.column("n").to_numpy())
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "row": pa.array([np.log(counts / counts.sum()).astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [languages, bins]) from the labelled rows of (doc_id, text, lang)."""
    K.ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    counted = K.saved(known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "langs")
    sizes = {r["lang"]: r["docs"] for r in counted.limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages, to which the broadcast model is bounded")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 1 << BITS), np.float32)
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(F.broadcast(counted), "lang").where(unit * F.col("docs") < per_lang)
    rows = drawn.select("lang", "text").mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = {r["lang"]: np.frombuffer(r["row"], "<f4") for r in rows.groupBy("lang").applyInArrow(_row_of_log_probabilities, "lang string, row binary").collect()}  # a row per language
    flat = np.full(1 << BITS, UNIFORM, np.float32)
    prior = np.array([sizes[x] for x in langs], float)
    return langs, np.log(prior / prior.sum()), np.stack([got.get(x, flat) for x in langs])


def score(texts: list[str], prior: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language (-1: none), its scaled posterior and the mean log probability of an n-gram in it, for each text."""
    bins, starts, has = features(texts)
    total, grams = np.zeros((len(texts), len(prior))), np.zeros(len(texts))
    for b, s in zip(bins, starts, strict=True):
        grams += s[1:] - s[:-1]
        for k in range(len(prior)):
            total[:, k] += _sums(table[k][b], s)
    if not len(prior):
        return np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan)
    logit = prior + total
    best, rows = logit.argmax(axis=1), np.arange(len(texts))
    p = np.exp((logit - logit.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None])
    p /= p.sum(axis=1, keepdims=True)
    return np.where(has, best, -1), np.where(has, p[rows, best], 0.0), np.where(has, total[rows, best] / np.maximum(grams, 1), np.nan)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns `keep` of docs with lang_pred, score and per_gram (null for `und`), in one narrow pass over whole texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    K.ship(spark)
    names, prior, table = model
    shared = spark.sparkContext.broadcast((names, prior, table))
    src = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    held = [f"_{i}" for i in range(len(keep))]
    final = src.select(*held).schema
    arrow = to_arrow_schema(final).append(pa.field("_pred", pa.string())).append(pa.field("_score", pa.float64())).append(pa.field("_gram", pa.float64()))
    spec = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in final] + ["_pred string", "_score double", "_gram double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p, t = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            best, value, gram = [], [], []
            for i, j in _blocks(texts):
                b, v, g = score(texts[i:j], p, t)
                best += [langs[k] if k >= 0 else "und" for k in b.tolist()]
                value.append(v)
                gram.append(g)
            arrays = [batch.column(c) for c in held] + [pa.array(best, pa.string()), *[pa.array(np.concatenate(x) if x else np.zeros(0), from_pandas=True) for x in (value, gram)]]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    out = src.mapInArrow(run, spec)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_gram").alias("per_gram"))


def held_out():
    """True for the third of documents by CRC-32 of the id's text that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score and per_gram of every document; learned from the two thirds that are not held out."""
    base = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(base.where(~F.col("held_out")), per_lang)
    return predict(base, model, ["doc_id", "held_out"])


def accepted(langs: list[str], least: float, sure: float):
    """Whether a scored row (lang, lang_pred, score, per_gram) is a document in a known language, and in the one it is labelled with."""
    contradicted = F.col("lang").isin(langs) & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= sure)
    return (F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("per_gram") > FIT) & ~F.coalesce(contradicted, F.lit(False))


def filter_stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5, sure: float = 0.9) -> DataFrame:
    """Documents in a language the model knows; the rejected go.

    Rejected: null, empty and letterless texts; texts that fit no known language (`FIT`);
    scores below `least`; labels of a learned language against a prediction of score `sure` or more. Rows with a null or
    unknown label are judged by their text alone, rows with a null id like any other; repeated rows stay repeated; where nothing can be learned
    all go; an empty table stays empty; extra columns go.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    base = docs.select(*columns).withColumn("_held", held_out())
    model = fit(base.where("not _held"))
    return predict(base, model, columns).where(accepted(model[0], least, sure)).select(*columns)
