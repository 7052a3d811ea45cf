"""Removal of byte strings that stand in an earlier document, by sorting suffixes.

A window is a suffix read to `length` bytes. Sorting the suffixes of all texts would move every text `length` times, so
windows are first dealt by their rarest part: the smallest hash of the 16-byte strings in them, their key. Windows in a row
with one key form a run, whose bytes are the suffix at its first window, read to the end of its last. Equal windows have equal keys.

1. Blocks of documents send their distinct keys (4 bytes and a count each), and learn which other blocks have too, and
   which are hot: in very many runs, such as a phrase that stands in varied surroundings.
2. Blocks sort the suffixes of the runs whose keys are shared deep-shallow, and send each distinct one once, with its least
   document. Runs of hot keys are sent window by window, each dealt by the hash of its own bytes.
3. Nodes sort what they get deep-shallow: first the runs, so that equal ones become one, then the windows of different
   runs under one key. They find the least document of each, and answer where it lies in front of the sender's own.
4. Blocks cut the bytes covered by windows with an earlier document.

A block sends one message to each of at most FAN buckets of the keys. When there are more parts than that, a bucket has
several nodes, each for a share of the blocks; a node merges what it gets, sends on each distinct key or run once to the finer parts
of its bucket, and hands the parts' answers down to its blocks. So messages grow with the input, not with blocks x
parts, and a passage that every block has is merged on the way. Texts are shuffled once and read three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_sort import deep_shallow_sort

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 4 << 20
PART_BYTES = 4 << 20
FAN = 4096
HOT = 8192
PIECE = 1 << 18
RUN = 64
NULL_ID = (1 << 63) - 1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64(0xFFFFFFFF)
KEYS = "node long, src long, bucket long, low binary, n binary"
SHARED = "src long, bucket long, low binary, hot binary"
STRINGS = "node long, src long, bucket long, number binary, least binary, key binary, size binary, data binary"
ANSWERS = "src long, same binary, same_least binary, other binary, other_least binary"


def _keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each window the smallest hash of its 16-byte strings, mixed once more."""
    with np.errstate(over="ignore"):
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
        h = eight[:-8] * _M1
        h ^= h >> np.uint64(29)
        h += eight[8:] * _M2
        h ^= h >> np.uint64(32)
        h *= _M3
        h ^= h >> np.uint64(29)
        width, step = length - GRAM + 1, 1
        while step * 2 <= width:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if width > step:
            h = np.minimum(h[: -(width - step)], h[width - step :])
        h *= _M1
        h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes], length: int, longest: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (bytes, document, place of the bytes' start in each document, first window, last window + 1, key) of all runs.

    Short texts share a piece, long ones are cut in pieces that overlap by length - 1 bytes; runs end at both and at RUN windows.
    """
    piece: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        flat = b"".join(p[2] for p in piece)
        sizes = np.array([len(p[2]) for p in piece])
        starts = np.cumsum(sizes) - sizes
        key = _keys(np.frombuffer(flat, np.uint8), length)
        n = len(key)
        valid = np.zeros(n + 1, np.int8)
        np.add.at(valid, np.minimum(starts, n), 1)
        np.add.at(valid, np.minimum(starts + sizes - length + 1, n), -1)
        ok = np.cumsum(valid[:n]) > 0
        edge = np.ones(n, bool)
        edge[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
        edge[starts[starts < n]] = True
        first = np.flatnonzero(edge)
        last = np.append(first[1:], n)
        first, last = first[ok[first]], last[ok[first]]
        if (long := last - first > RUN).any():
            cut = [np.arange(a, b, RUN) for a, b in zip(first[long].tolist(), last[long].tolist())]
            ends = [np.append(c[1:], b) for c, b in zip(cut, last[long].tolist())]
            first, last = np.concatenate([first[~long], *cut]), np.concatenate([last[~long], *ends])
            order = np.argsort(first)
            first, last = first[order], last[order]
        which = np.searchsorted(starts, first, "right") - 1
        docs, shift = np.array([p[0] for p in piece]), np.array([p[1] for p in piece]) - starts
        return flat, docs[which], shift[which], first, last, key[first]

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, longest):
            part = text if len(text) <= longest else text[a : a + longest + length - 1]
            piece.append((i, a, part))
            size += len(part)
            if size >= longest:
                yield close()
                piece, size = [], 0
            if part is text:
                break
    if piece:
        yield close()

def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _shared_keys(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys that two documents or more have; docs ascend."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    return _distinct(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def _in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def _joined(column, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in column]])


def _scaled(bits: np.ndarray, n: int) -> np.ndarray:
    """32 bits to 0 ... n - 1."""
    return (bits * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class _Plan:
    """Buckets of keys, and the nodes and finer parts of each."""

    def __init__(self, total: int):
        parts = max(1, -(-total // PART_BYTES))
        self.blocks = max(1, -(-total // BLOCK_BYTES))
        self.buckets = min(parts, FAN)
        self.deep = min(FAN, -(-parts // FAN))  # nodes of a bucket, and parts of it; with one, nodes answer by themselves
        self.hot, self.piece = HOT, PIECE

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return _scaled(keys >> np.uint64(32), self.buckets)

    def name(self, keys: np.ndarray) -> np.ndarray:
        """A key as its bucket and its 4 low bytes."""
        return self.bucket(keys).astype(np.uint64) << np.uint64(32) | keys & _LOW

    def node(self, bucket: int, block: int) -> int:
        return bucket * self.deep + block % self.deep

    def parts(self, low: np.ndarray) -> np.ndarray:
        return _scaled(low.astype(np.uint64), self.deep)


def _dealt(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(destination, its share of each column) for each destination there is."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(to[a]), [c[order[a:b]] for c in columns]


def _window_hash(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for column in padded.view("<u8").T:
            h = (h ^ column) * _M3
            h ^= h >> np.uint64(32)
        h *= _M1
    return h ^ h >> np.uint64(29)


class _Suffixes:
    """Suffixes of a text read to their ends, and their classes: equal ones, in sorted order."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.flat, self.starts, self.sizes = flat, starts, sizes
        width = int(sizes.max(initial=0)) + 1
        views = np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(width, np.uint8)), width)
        rows = views[starts]
        rows[np.arange(width) >= sizes[:, None]] = 0
        rows[:, -1] = sizes  # under 256
        order, equal = deep_shallow_sort(rows)
        self.order, self.first = order, np.flatnonzero(np.diff(equal, prepend=-1))
        self.of = np.empty(len(starts), np.int64)
        self.of[order] = equal
        self.some = order[self.first]  # one member of each class

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value in each class."""
        return np.minimum.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def bytes_of(self, members: np.ndarray) -> bytes:
        starts, sizes = self.starts[members], self.sizes[members]
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)
        return self.flat[at].tobytes()


class _Block:
    """The runs of one block of documents, numbered in the order in which they are found."""

    def __init__(self, ids: pd.Series, texts: pd.Series, length: int, longest: int = PIECE):
        filled = ids.astype("Int64").fillna(NULL_ID).astype("int64").to_numpy()
        texts = [t or b"" for t in texts]
        if len(_distinct(filled)) < len(filled):  # rows with one id in an order that every step finds again
            self.order = np.lexsort(([hashlib.blake2b(t, digest_size=8).digest() for t in texts], filled))
        else:
            self.order = np.argsort(filled)
        self.ids, self.texts, self.length = filled[self.order], [texts[i] for i in self.order.tolist()], length
        pieces = list(runs(self.texts, length, longest))
        self.flat = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
        base = np.cumsum([0, *[len(p[0]) for p in pieces]])
        join = lambda values, kind: np.concatenate([np.empty(0, kind), *values])
        self.docs = join([p[1] for p in pieces], np.int64)
        self.start = join([p[3] + b for p, b in zip(pieces, base)], np.int64)
        self.place = join([p[2] + p[3] for p in pieces], np.int64)
        self.windows = join([p[4] - p[3] for p in pieces], np.int64)
        self.key = join([p[5] for p in pieces], np.uint64)
        self.shared = _shared_keys(self.ids[self.docs], self.key)

    def suffixes(self, wanted: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Suffixes]:
        """(number, run, suffixes) of the runs that are wanted, whole if their keys aren't hot, else window by window.

        A number is the run's times 128, for a window with its place in the run times 2 and 1 more.
        """
        whole, apart = np.flatnonzero(wanted & ~hot), np.flatnonzero(wanted & hot)
        n = self.windows[apart]
        run = np.repeat(apart, n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        number = np.concatenate([whole << 7, run << 7 | offset << 1 | 1])
        starts = np.concatenate([self.start[whole], self.start[run] + offset])
        sizes = np.concatenate([self.windows[whole] + self.length - 1, np.full(len(run), self.length)])
        return number, np.concatenate([whole, run]), _Suffixes(self.flat, starts, sizes)


def _bytes(values: pd.Series) -> pd.Series:
    return values.map(lambda t: t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t)


def _names(found: pd.DataFrame | list[dict], column: str) -> np.ndarray:
    rows = found if isinstance(found, list) else found.to_dict("records")
    return np.sort(np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r[column], "<u4").astype(np.uint64) | np.uint64(r["bucket"]) << np.uint64(32) for r in rows if r[column]]]))


def merge_keys(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct low bytes, and for each twice the runs that it is in, and 1 more if several blocks have it."""
    low, n = _joined(f["low"], "<u4"), _joined(f["n"], "<u2").astype(np.int64)
    keys, at, senders = np.unique(low, return_inverse=True, return_counts=True)
    total = np.bincount(at, n >> 1, len(keys)).astype(np.int64)
    several = (np.bincount(at, n & 1, len(keys)) > 0) | (senders > 1)
    return keys, total << 1 | several


def answer_keys(f: pd.DataFrame, most: int, above: pd.DataFrame | None = None) -> pd.DataFrame:
    """For each sender its keys that several blocks have, and those that are hot; as merged here, or as a finer part has answered."""
    if above is None:
        keys, n = merge_keys(f)
        several, hot = keys[n & 1 > 0], keys[n >= 2 * most]
    else:
        several, hot = np.sort(_joined(above["low"], "<u4")), np.sort(_joined(above["hot"], "<u4"))
    out = []
    for src, bucket, low in zip(f["src"], f["bucket"], f["low"]):
        low = np.frombuffer(low, "<u4")
        common, burning = low[_in(low, several)], low[_in(low, hot)]
        if len(common) or len(burning):
            out.append((src, bucket, common.tobytes(), burning.tobytes()))
    return pd.DataFrame(out, columns=["src", "bucket", "low", "hot"])


class _Received:
    """Suffixes from several senders, sorted, with the least document of each class."""

    def __init__(self, f: pd.DataFrame):
        self.senders = f["src"].tolist()
        self.number = [np.frombuffer(x, "<i8") for x in f["number"]]
        self.own = [np.frombuffer(x, "<i8") for x in f["least"]]
        sizes = _joined(f["size"], "<i4").astype(np.int64)
        self.suffixes = s = _Suffixes(np.frombuffer(b"".join(f["data"]), np.uint8), np.cumsum(sizes) - sizes, sizes)
        self.least = s.least(_joined(f["least"], "<i8"))
        self.key = _joined(f["key"], "<u8")[s.some]

    def windows(self, length: int) -> dict[int, np.ndarray]:
        """By class, the least document of each window, where one lies in front of the class's own; windows under one key are sorted together."""
        s, out = self.suffixes, {}
        _, group, size = np.unique(self.key, return_inverse=True, return_counts=True)
        todo = np.flatnonzero(size[group] > 1)  # alone under its key: all windows have the class's least document
        todo = todo[np.argsort(group[todo], kind="stable")]
        edges = np.append(np.flatnonzero(np.append(True, np.diff(group[todo]) > 0)), len(todo)) if len(todo) else np.zeros(1, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(s.flat, length) if len(todo) else None
        at = 0
        while at < len(edges) - 1:  # whole groups, some thousand runs at a time
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 4096, "right")) - 1)
            members = todo[edges[at] : edges[to]]
            sizes = s.sizes[s.some[members]] - length + 1
            ends = np.cumsum(sizes)
            rows = views[np.arange(ends[-1]) + np.repeat(s.starts[s.some[members]] - ends + sizes, sizes)]
            order, equal = deep_shallow_sort(rows)
            document = np.repeat(self.least[members], sizes)
            least = np.empty(len(rows), np.int64)
            least[order] = np.minimum.reduceat(document[order], np.flatnonzero(np.diff(equal, prepend=-1)))[equal]
            for k in np.flatnonzero(np.minimum.reduceat(least, ends - sizes) < self.least[members]).tolist():
                out[int(members[k])] = least[ends[k] - sizes[k] : ends[k]]
            at = to
        return out


def answer_strings(f: pd.DataFrame, length: int, above: pd.DataFrame | None = None) -> pd.DataFrame:
    """For each sender its suffixes of which windows have an earlier document: one for all windows (same), or one each (other)."""
    got = _Received(f)
    if above is None:
        varied = got.windows(length)
    else:
        same, other, lists = _read_answers(above, lambda number: got.suffixes.sizes[got.suffixes.some[number]] - length + 1)
        for c, d in same:
            got.least[c] = min(got.least[c], d)
        varied = dict(zip(other, lists))
    earliest = got.least.copy()
    for c, x in varied.items():
        earliest[c] = x.min()
    is_varied = np.zeros(len(got.least), bool)
    is_varied[list(varied)] = True
    out, at = [], 0
    for src, number, own in zip(got.senders, got.number, got.own):
        c = got.suffixes.of[at : at + len(number)]
        at += len(number)
        better = earliest[c] < own
        same, other = np.flatnonzero(better & ~is_varied[c]), np.flatnonzero(better & is_varied[c])
        if len(same) or len(other):
            lists = np.concatenate([np.empty(0, "<i8"), *[varied[k] for k in c[other].tolist()]]).astype("<i8")
            out.append((src, number[same].tobytes(), got.least[c[same]].astype("<i8").tobytes(), number[other].tobytes(), lists.tobytes()))
    return pd.DataFrame(out, columns=["src", "same", "same_least", "other", "other_least"])


def _read_answers(rows: pd.DataFrame, windows: Callable[[np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], list[int], list[np.ndarray]]:
    same = list(zip(_joined(rows["same"], "<i8").tolist(), _joined(rows["same_least"], "<i8").tolist()))
    other, least = _joined(rows["other"], "<i8"), _joined(rows["other_least"], "<i8")
    ends = np.cumsum(windows(other)) if len(other) else np.empty(0, np.int64)
    return same, other.tolist(), np.split(least, ends[:-1]) if len(other) else []


def string_rows(to: np.ndarray, node: Callable[[int], int], src: int, bucket: Callable[[int], int], number: np.ndarray, least: np.ndarray, key: np.ndarray, s: _Suffixes) -> pd.DataFrame:
    """The classes of s, dealt: one row a destination."""
    out = []
    for k, (i, n, d, h) in _dealt(to, [np.arange(len(s.some)), number, least, key]):
        members = s.some[i]
        out.append((node(k), src, bucket(k), n.astype("<i8").tobytes(), d.astype("<i8").tobytes(), h.astype("<u8").tobytes(), s.sizes[members].astype("<i4").tobytes(), s.bytes_of(members)))
    return pd.DataFrame(out, columns=["node", "src", "bucket", "number", "least", "key", "size", "data"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of docs with sx_kept (binary: the bytes that stay), sx_bytes, sx_removed, sx_spans.

    With as_text, sx_kept is a string, without the rests of characters that were cut in two.

    A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id, overlaps included, judged on
    the input. Strings never cross documents. Null texts are empty; texts under `length` bytes stay whole. A null id counts
    as larger than all others; rows with one id never cut each other. Long texts are read in pieces; an
    empty table gives an empty one. Columns whose names begin with sx_ are replaced.
    """
    if not GRAM < length <= 255 - RUN:
        raise ValueError(f"length must be over {GRAM} and at most {255 - RUN}")
    rows = docs.drop(*[c for c in docs.columns if c.startswith("sx_")])
    plan = _Plan(rows.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)
    at = rows.withColumn("sx_block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("block")), F.lit(plan.blocks))).repartition("sx_block")  # by the row, as an id may stand in many rows
    slim = at.groupBy("sx_block")

    def send_keys(f: pd.DataFrame) -> pd.DataFrame:
        b, block = _Block(f[id_col], _bytes(f[text_col]), length, plan.piece), int(f["sx_block"].iloc[0])
        keys, n = np.unique(b.key, return_counts=True)
        n = np.minimum(n, 0x7FFF).astype("<u2") << 1
        out = [(plan.node(k, block), block, k, (x & _LOW).astype("<u4").tobytes(), c.tobytes()) for k, (x, c) in _dealt(plan.bucket(keys), [keys, n])]
        return pd.DataFrame(out, columns=["node", "src", "bucket", "low", "n"])

    def forward_keys(f: pd.DataFrame) -> pd.DataFrame:
        keys, n = merge_keys(f)
        n = (np.minimum(n >> 1, 0x7FFF) << 1 | n & 1).astype("<u2")
        node, bucket = int(f["node"].iloc[0]), int(f["bucket"].iloc[0])
        out = [(bucket * plan.deep + k, node, bucket, x.tobytes(), c.tobytes()) for k, (x, c) in _dealt(plan.parts(keys), [keys, n])]
        return pd.DataFrame(out, columns=["node", "src", "bucket", "low", "n"])

    def send_strings(f: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return string_rows(np.empty(0, np.int64), int, 0, int, np.empty(0), np.empty(0), np.empty(0), _Suffixes(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)))
        b, block = _Block(f[id_col], _bytes(f[text_col]), length, plan.piece), int(f["sx_block"].iloc[0])
        mine = plan.name(b.key)
        number, run, s = b.suffixes(_in(mine, _names(shared, "low")) | _in(b.key, b.shared), _in(mine, _names(shared, "hot")))
        key = b.key[run[s.some]]
        apart = np.flatnonzero(number[s.some] & 1)
        if len(apart):  # windows of hot keys
            key[apart] = _window_hash(np.lib.stride_tricks.sliding_window_view(b.flat, length)[s.starts[s.some[apart]]])
        bucket = plan.bucket(key)
        return string_rows(bucket, lambda k: plan.node(k, block), block, lambda k: k, s.least(number), s.least(b.ids[b.docs[run]]), key, s)

    def forward_strings(f: pd.DataFrame) -> pd.DataFrame:
        got, node, bucket = _Received(f), int(f["node"].iloc[0]), int(f["bucket"].iloc[0])
        return string_rows(plan.parts(got.key & _LOW), lambda k: bucket * plan.deep + k, node, lambda k: bucket, np.arange(len(got.least)), got.least, got.key, got.suffixes)

    out_schema = at.drop("sx_block").schema
    for name, kind in (("sx_kept", "string" if as_text else "binary"), ("sx_bytes", "long"), ("sx_removed", "long"), ("sx_spans", "long")):
        out_schema = out_schema.add(name, kind)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = table.column(id_col).to_pandas(integer_object_nulls=True), _bytes(table.column(text_col).to_pandas())
        b = _Block(ids, texts, length, plan.piece)
        same, other, lists = _read_answers({c: [x for x in answers.column(c).to_pylist() if x] for c in ("same", "same_least", "other", "other_least")}, lambda number: np.where(number & 1, 1, b.windows[number >> 7]))
        hot = _in(plan.name(b.key), _names(answers.select(["bucket", "hot"]).to_pylist(), "hot"))
        marked = np.array([n >> 7 for n, _ in same] + [n >> 7 for n in other], np.int64)
        number, run, s = b.suffixes(_in(b.key, np.union1d(b.key[marked], b.shared)), hot)
        mine = b.ids[b.docs[run]]
        least = s.least(mine)
        names = s.least(number)  # by which a class was sent
        by_name = np.argsort(names)
        class_of = lambda n: by_name[np.searchsorted(names, n, sorter=by_name)]
        if same:
            n, d = np.array(same, np.int64).T
            c = class_of(n)
            least[c] = np.minimum(least[c], d)
        varied = dict(zip(class_of(np.array(other, np.int64)).tolist(), lists)) if other else {}
        is_varied = np.zeros(len(least), bool)
        is_varied[list(varied)] = True
        place = b.place[run] + np.where(number & 1, number >> 1 & 63, 0)
        whole = np.flatnonzero(~is_varied[s.of] & (least[s.of] < mine))
        doc, begin, end = [b.docs[run[whole]]], [place[whole]], [place[whole] + s.sizes[whole]]
        for i in np.flatnonzero(is_varied[s.of]).tolist():
            w = np.flatnonzero(np.minimum(varied[int(s.of[i])], least[s.of[i]]) < mine[i])
            doc.append(np.full(len(w), b.docs[run[i]]))
            begin.append(place[i] + w)
            end.append(place[i] + w + length)
        spans = _united(np.concatenate(doc), np.concatenate(begin), np.concatenate(end), b.texts)
        kept: list = [None] * len(b.texts)
        counts = np.zeros((len(b.texts), 3), np.int64)
        for d, text in enumerate(b.texts):
            own = spans.get(d, [])
            edges = [0, *own, len(text)]
            row = b.order[d]
            kept[row] = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            counts[row] = len(text), len(text) - len(kept[row]), len(own) // 2
        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        table = table.drop_columns(["sx_block"]).append_column("sx_kept", left)
        for i, name in enumerate(("sx_bytes", "sx_removed", "sx_spans")):
            table = table.append_column(name, pa.array(counts[:, i], pa.int64()))
        return table

    def exchanged(sent: DataFrame, forward: Callable, answer: Callable, schema: str, answers: str) -> DataFrame:
        nodes = sent.groupBy("node")
        if plan.deep == 1:
            return nodes.applyInPandas(lambda f: answer(f), answers)
        finer = nodes.applyInPandas(forward, schema).groupBy("node").applyInPandas(lambda f: answer(f), answers)
        return nodes.cogroup(finer.groupBy("src")).applyInPandas(lambda f, above: answer(f, above), answers)

    shared = exchanged(slim.applyInPandas(send_keys, KEYS), forward_keys, lambda f, above=None: answer_keys(f, plan.hot, above), KEYS, SHARED)
    sent = slim.cogroup(shared.groupBy("src")).applyInPandas(send_strings, STRINGS)
    answers = exchanged(sent, forward_strings, lambda f, above=None: answer_strings(f, length, above), STRINGS, ANSWERS)
    hot = shared.filter(F.octet_length("hot") > 0).select("src", "bucket", "hot")
    return slim.cogroup(answers.unionByName(hot, allowMissingColumns=True).groupBy("src")).applyInArrow(cut, out_schema)


def _united(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, texts: list[bytes]) -> dict[int, list[int]]:
    """By document the edges of the spans, with those that meet made one."""
    if not len(doc):
        return {}
    base = np.cumsum([0, *[len(t) + 1 for t in texts]])  # one place between documents
    begin, end = base[doc] + begin, base[doc] + end
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    begin, end = begin[new], end[np.append(new[1:], True)]
    doc = np.searchsorted(base, begin, "right") - 1
    out: dict[int, list[int]] = {}
    for d, x, y in zip(doc.tolist(), (begin - base[doc]).tolist(), (end - base[doc]).tolist()):
        out.setdefault(d, []).extend((x, y))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings cut out of text; a character of which a part is cut goes whole. n_chars, if there, is counted anew."""
    cut = repeated_spans(docs, length, id_col, text_col, as_text=True).withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("sx_kept")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.char_length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
