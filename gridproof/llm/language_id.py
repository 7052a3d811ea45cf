"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of byte n-grams (1 to 3, of the lower-cased text) that both have, over the
geometric mean of how many each has. N-grams are held as presence bits in 2**BITS hashed places. Landmarks give a Nyström
map of the kernel, one-versus-rest kernel ridge regression is solved in it, and because the kernel is linear in the
presence bits, landmarks and weights fold into one matrix that scores a batch in one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 15
SAMPLE_PER_LANGUAGE = 400
LANDMARKS = 256
RIDGE = 1e-2
BATCH = 64
CHUNK = 1 << 20


def presence(text: str, chunk: int = CHUNK) -> np.ndarray:
    """Presence bits (bool) of the n-grams of a whole text, read in chunks that overlap by two bytes."""
    seen = np.zeros(1 << BITS, bool)
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    for i in range(0, len(data), chunk):
        one = data[i : i + chunk + 2].astype(np.uint32)
        seen[one] = True
        two = one[:-1] << np.uint32(8) | one[1:]
        for grams, odd in ((two, 2654435761), (two[:-1] << np.uint32(8) | one[2:], 2246822519)):
            seen[(grams * np.uint32(odd)) >> np.uint32(32 - BITS)] = True
    return seen


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix W (places x languages) with scores = (bits @ W) / sqrt(number of bits)."""
    names = sorted(set(labels))

    def unit(rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    base = unit(bits[np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int)])  # the rows are in the order of a hash
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([(unit(bits[i : i + BATCH]) @ base.T).astype(np.float64) for i in range(0, len(bits), BATCH)]) @ to_map  # a batch of rows as numbers at a time
    y = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0)
    alpha = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return names, np.ascontiguousarray(base.T @ (to_map @ alpha), np.float32)


def limits(bits: np.ndarray, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """By language in the order of their names: the places seen in its rows (places x languages), and the least share of a text's n-grams that must be among them.

    Every fifth row is held out. The least share lies midway between what the poorest 1 % of these rows have in their own
    language and what the median row has in another one (or without another, with its places in random order).
    """
    names = sorted(set(labels))
    own = np.array(labels)[:, None] == np.array(names)[None]
    seen = np.stack([bits[o].any(0) for o in own.T], 1)
    held = np.arange(len(bits)) % 5 == 4
    if not held.any():
        return seen, np.full(len(names), 0.5)
    known = np.stack([bits[o & ~held].any(0) for o in own.T], 1).astype(np.float32)
    rows = bits[held].astype(np.float32)  # a fifth of the sample
    share = rows @ known / np.maximum(rows.sum(1, keepdims=True), 1)
    least = np.empty(len(names))
    for i in range(len(names)):
        mine, others = share[own[held][:, i], i], share[~own[held][:, i], i]
        if not len(others):
            others = rows @ known[np.random.default_rng(0).permutation(len(known)), i] / np.maximum(rows.sum(1), 1)
        least[i] = (np.quantile(mine, 0.01) + np.median(others)) / 2 if len(mine) else 0.5
    return seen, least


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, list[str]]:
    """Presence bits and languages of at most per_language labelled rows of each language, those with the smallest hash of id and text.

    Rows without a language, or whose text has no letter, are no examples. Rows that repeat in both are one. The bound is exact before anything
    comes to the driver, and only presence bits (4 KB a row) do.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample"))
    sizes = {r[0]: max(1, r[1]) for r in labelled.groupBy(lang_col).agg(F.approx_count_distinct(order)).collect()}  # a row a language
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, (1.5 * per_language + 50) / n)))]) if sizes else None
    if rate is None:
        return np.empty((0, 1 << BITS), bool), []
    likely = labelled.filter(F.pmod(order, F.lit(1 << 31)) < rate[F.col(lang_col)] * F.lit(1 << 31))  # somewhat more than the bound, by a hash
    each = likely.groupBy(F.col(lang_col).alias("lang"), order.alias("h")).agg(F.min(text_col).alias("text"))
    drawn = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= per_language)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"h": f["h"], "lang": f["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in f["text"]]})

    rows = drawn.select("h", "lang", "text").mapInPandas(features, "h long, lang string, bits binary").collect()
    if not rows:
        return np.empty((0, 1 << BITS), bool), []
    kept = sorted(rows, key=lambda r: (r["h"], r["lang"], bytes(r["bits"])))
    bits = np.empty((len(kept), 1 << BITS), bool)
    for i, r in enumerate(kept):
        bits[i] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return bits, [r["lang"] for r in kept]


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on the sample. Without any example there are no languages."""
    bits, labels = sample(docs, per_language, id_col, text_col, lang_col)
    return fit(bits, labels) if labels else ([], np.empty((1 << BITS, 0), np.float32))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1).

    Every whole text is scored. A null text and one without letters, or any text when the model knows no language, is
    `und` with score 0. With `known` (of `limits`) a text is also `und`, with its score, if for no language enough of its n-grams
    were seen. Ties go to the first language by name. Repeated rows and null ids pass through; columns named
    lang_pred or score are replaced.
    """
    names, weights = model
    rows = docs.drop("lang_pred", "score", "_language")
    seen, least = known if known and names else (np.empty((1 << BITS, 0), bool), np.empty(0))
    kept = docs.sparkSession.sparkContext.broadcast((weights, seen.astype(np.float32)))  # places x languages, fixed

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        w, places = kept.value
        out = [("und", 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if names and has_letter(t)]
        for k in range(0, len(todo), BATCH):
            at = todo[k : k + BATCH]
            bits = np.stack([presence(texts.iloc[i]) for i in at]).astype(np.float32)
            score = bits @ w / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))
            best = score.argmax(1)
            alien = (bits @ places < least * bits.sum(1, keepdims=True)).all(1) if len(least) else np.zeros(len(at), bool)
            for i, b, s, no in zip(at, best, score, alien):
                out[i] = ("und" if no else names[b], float(np.clip((s[b] + 1) / 2, 0, 1)))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return rows.withColumn("_language", scored(F.col(text_col))).select(*rows.columns, "_language.lang_pred", "_language.score")
