"""Fill-in-the-middle training texts over an index of the distinct texts.

Rows are grouped by their text's SHA-256, and a group counts as one text only if length and a second hash agree over all of its rows.
So each distinct text moves once, however many copies it has, and its boundaries (byte offsets of the places between units) are
listed once, as an Elias-Fano list of two to three bits a unit. Documents, as pairs of id and digest, are joined to the
index and take their two seeded cuts by select on the list, without going through the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20  # of all documents, and of those that are cut
COPIES = 1000  # documents of one text in a task; a text with more is sent to several
HOT = 1_000_000  # texts that can be sent to several tasks; beyond 10**9 documents a task gets rows / HOT of a text
BLOCK = 4096  # bits of an Elias-Fano list between two counted places


class EliasFano:
    """A non-decreasing list of integers: low bits packed, high parts in unary, ones counted at every BLOCK bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(bool)) if low_bits else np.empty(0, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, bool)
        bits[places] = True
        high = np.packbits(bits)
        counts = np.searchsorted(places, np.arange(0, max(len(bits), 1), BLOCK)).astype("<u4")
        return cls(n, low_bits, low, high, counts)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.counts, i, "right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        place = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.counts[block])])
        if not self.low_bits:
            return place - i
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8])[first % 8 : first % 8 + self.low_bits]
        return (place - i << self.low_bits) + int(bits @ (1 << np.arange(self.low_bits)))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.counts), len(self.low)], "<u8").tobytes() + self.counts.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_counts, n_low = np.frombuffer(data, "<u8", 4).tolist()
        at = 32 + 4 * n_counts
        return cls(n, low_bits, np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, -1, at + n_low), np.frombuffer(data, "<u4", n_counts, 32))


def boundaries(data: bytes) -> np.ndarray:
    """Byte offsets at which a code point of UTF-8 begins, and the end."""
    return np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))


def _digested(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("fm_digest"), text.alias("fm_text"))


def _distinct(rows: DataFrame) -> DataFrame:
    """fm_digest, fm_text, fm_copies of digested rows; copies are put together before the shuffle. Length and a second hash verify that a digest has one text."""
    checks = [F.xxhash64("fm_text"), F.octet_length("fm_text").cast("long")]
    grouped = rows.groupBy("fm_digest").agg(F.first("fm_text").alias("fm_text"), F.count("*").alias("fm_copies"), *[f(c).alias(f"fm_{f.__name__}{i}") for i, c in enumerate(checks) for f in (F.min, F.max)])
    same = (F.col("fm_min0") == F.col("fm_max0")) & (F.col("fm_min1") == F.col("fm_max1"))
    return grouped.select("fm_digest", F.when(same, F.col("fm_text")).otherwise(F.raise_error(F.lit("two texts have one digest"))).alias("fm_text"), "fm_copies")


def _listed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: EliasFano.of(boundaries(t.encode("utf-8", "surrogatepass"))).to_bytes())


def _bounds(texts: DataFrame) -> DataFrame:
    """fm_digest, fm_bounds: the Elias-Fano list of each text's boundaries. The texts themselves don't move again."""
    return texts.select("fm_digest", F.pandas_udf(_listed, "binary")("fm_text").alias("fm_bounds"))


def text_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """fm_digest, fm_text, fm_copies, fm_bounds: one row for each distinct text, a null one being empty."""
    texts = _distinct(_digested(docs, text_col))
    return texts.join(_bounds(texts), "fm_digest")


def _cuts(bounds: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Units of the text, and the ends of prefix and middle in units (a, b) and in bytes (x, y)."""
    rows = []
    for data, one, two in zip(bounds, h1, h2):
        at = EliasFano.from_bytes(data)
        a, b = sorted((one % at.n, two % at.n))  # the list has a place more than units
        rows.append((at.n - 1, a, b, at.select(a), at.select(b)))
    return pd.DataFrame(rows, columns=["n", "a", "b", "x", "y"])


def _cut_and_text(pairs: DataFrame, texts: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """pairs with fm_cut, from the list of their text, and then the text itself: lists are small and texts already lie where their digest belongs."""
    cuts = F.pandas_udf(_cuts, "n long, a long, b long, x long, y long")
    cut = pairs.join(bounds, keys).withColumn("fm_cut", cuts("fm_bounds", "fm_h1", "fm_h2")).drop("fm_bounds")
    return cut.join(texts.select(*keys, "fm_text"), keys).select("fm_id", "fm_h3", "fm_h4", "fm_cut", "fm_text")


def _with_index(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """pairs (fm_id, fm_digest, fm_h1 to fm_h4) with fm_cut and fm_text.

    A text of many documents is sent to as many tasks as they need. Which texts these are is broadcast: no more than HOT can have over rows / HOT copies.
    """
    most = max(COPIES, -(-docs.count() // HOT))
    copies = pairs.groupBy("fm_digest").count().filter(F.col("count") > most)
    hot = F.broadcast(written(copies.select("fm_digest", F.ceil(F.col("count") / most).cast("int").alias("fm_parts")), "hot-texts"))
    dealt = written(pairs.withColumn("fm_row", F.monotonically_increasing_id()).join(hot, "fm_digest", "left"), "pairs")
    rows = _digested(docs, text_col)
    texts = _distinct(rows.join(hot, "fm_digest", "left_anti"))
    few = _cut_and_text(dealt.filter("fm_parts IS NULL"), texts, ["fm_digest"], _bounds(texts))
    if hot.isEmpty():
        return few
    texts = _distinct(rows.join(hot, "fm_digest", "left_semi"))
    spread = lambda t: t.join(hot, "fm_digest").withColumn("fm_part", F.explode(F.sequence(F.lit(0), F.col("fm_parts") - 1))).drop("fm_parts")
    many = dealt.filter("fm_parts IS NOT NULL").withColumn("fm_part", F.pmod(F.xxhash64("fm_row"), F.col("fm_parts")).cast("int"))
    return few.unionByName(_cut_and_text(many, spread(texts), ["fm_digest", "fm_part"], spread(_bounds(texts))))


def fill_in_middle(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output for every row: its text, cut at two seeded places and put in another order.

    Places count code points. Four numbers h1 to h4 come from the SHA-256 of `seed:id`. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) code points,
    the middle after the larger. A text stays plain (form `plain`, no lengths) if it is empty, has one of the marks in it, or h3 % 100 >= 90. Otherwise the
    suffix comes first (spm) if h4 % 100 < 20, and after the prefix (psm) if not. A null text is empty, a null id is cut as
    an id without digits. Repeated rows give one row each, the same ones if id and text are the same. Texts of any length are cut whole, other
    columns are ignored, and an empty table gives an empty result.
    """
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    draw = [F.conv(F.substring("fm_seed", 8 * i + 1, 8), 16, 10).cast("long").alias(f"fm_h{i + 1}") for i in range(4)]
    pairs = docs.select(F.col(id_col).alias("fm_id"), digest.alias("fm_digest"), seeded.alias("fm_seed")).select("fm_id", "fm_digest", *draw)
    at = _with_index(pairs, docs, text_col)
    n, a, b, x, y = (F.col(f"fm_cut.{c}") for c in "nabxy")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("fm_text", F.lit(mark))
    form = F.when((n == 0) | (F.col("fm_h3") % 100 >= 100 - PLAIN_PERCENT) | marked, "plain").when(F.col("fm_h4") % 100 < SPM_PERCENT, "spm").otherwise("psm")
    data = F.col("fm_text").cast("binary")  # cut by bytes, as the list says
    piece = lambda start, end: F.substring(data, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), x), piece(x, y), piece(y, F.octet_length(data))
    plain = F.col("form") == "plain"
    output = F.when(plain, F.col("fm_text")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    )
    return at.withColumn("form", form).select(F.col("fm_id").alias(id_col), n.alias("n"), "form", F.when(~plain, a).alias("prefix_chars"), F.when(~plain, b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # no text that is cut has a mark
    order = lambda *at: F.concat(*[F.element_at(parts, i + 1) for i in at])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)
