"""Evaluation texts that leak into training text.

Method: the test items' n-grams of normalised words form a hash set that is broadcast. Documents are scanned in Arrow batches: any
window of n words holds exactly one word at a position n - 1 modulo n, so only those words are probed, and where one is in
the items' vocabulary the windows of the run of such words around it are looked up. A window whose hash is known is
compared with the item word by word, so a hash collision is no hit.

The set is an array of sorted 64-bit hashes, 16 bytes an n-gram, made once on the driver. Its size is bounded: items of more than
``max_item_chars`` characters are cut into blocks by a hash of their id and the documents are scanned once a block, by the same
code. Every item is in one block, so the result is the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.shared import materialize

WORDS = 12
#: Characters of items in a block, of which one is broadcast.
MAX_ITEM_CHARS = 8 << 20

_DROP = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_BREAK = re.compile("(?<=[^\\W_])[-\u2010][^\\S\\r\\n]*(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x85\u2028\u2029])[^\\S\\r\\n]*(?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """NFKC, without soft hyphens, zero-width characters and hyphens that only break a line, in lower case."""
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", text))
    if "-" in text or "\u2010" in text:
        text = _BREAK.sub("", text)
    return text.lower()


def words_of(text: str) -> list[str]:
    """The maximal runs of letters and digits."""
    return _WORD.findall(normalise(text))


class Items:
    """The items' n-grams: their hashes in order, and where each is; the vocabulary. An id may stand in several rows."""

    def __init__(self, rows: Sequence[tuple[object, str | None]], n: int = WORDS):
        self.n, self.vocabulary, self.ids = n, {}, []
        words, where, of = [], [], []
        for item, text in rows:
            mine = words_of(text or "")
            if len(mine) >= n:
                where.append(np.arange(len(words), len(words) + len(mine) - n + 1))
                of.append(np.full(len(mine) - n + 1, len(self.ids), dtype=np.int32))
                words += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in mine]
                self.ids.append(item)
        self.words = np.array(words, dtype=np.int32)
        self.at = np.concatenate(where) if where else np.zeros(0, dtype=np.int64)
        self.of = np.concatenate(of) if of else np.zeros(0, dtype=np.int32)
        hashes = self._hashes(self.words)[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.of = hashes[order], self.at[order], self.of[order]

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        """Of each window of n words."""
        count = len(words) - self.n + 1
        with np.errstate(over="ignore"):
            mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            h = np.zeros(count, dtype=np.uint64)
            for k in range(self.n):
                h = h * np.uint64(0xD1342543DE82EF95) + mixed[k : k + count]
        return h

    def hits(self, words: Sequence[str]) -> dict[object, list[int]]:
        """For each item the windows of ``words`` (their first word's place) that it holds."""
        n, known = self.n, self.vocabulary
        found: dict[object, list[int]] = {}
        done, size = 0, len(words)
        for i in range(n - 1, size, n):
            if i < done or words[i] not in known:
                continue
            a, b = i, i + 1
            while a > 0 and words[a - 1] in known:
                a -= 1
            while b < size and words[b] in known:
                b += 1
            done = b
            if b - a < n:
                continue
            run = np.array([known[w] for w in words[a:b]], dtype=np.int32)
            hashes = self._hashes(run)
            low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            for j in np.flatnonzero(high > low):
                for k in range(low[j], high[j]):
                    if np.array_equal(self.words[self.at[k] : self.at[k] + n], run[j : j + n]):
                        starts = found.setdefault(self.ids[self.of[k]], [])
                        if not starts or starts[-1] != a + j:
                            starts.append(a + int(j))
        return found


def _blocks(items: DataFrame, item_id: str, text: str, n: int, limit: int) -> list[Broadcast]:
    """The items in broadcasts of about ``limit`` characters each; one item is not cut."""
    chars = items.agg(F.sum(F.length(text))).first()[0] or 0
    count = 1 if chars <= limit else 2 * chars // max(limit, 1) + 1
    context, out = items.sparkSession.sparkContext, []
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(count)) == k)
        rows = [tuple(r) for r in part.select(item_id, text).collect()]
        if rows or not k:
            out.append(context.broadcast(Items(rows, n)))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", n: int = WORDS, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """doc_id, item_id and ``n_grams`` (windows of the document that the item holds) for each document with at least ``n``
    consecutive words of an item.

    Null and empty texts and items of fewer words have no window; texts of any length are scanned whole; repeated document
    rows are reported once a row; of items with one id any text counts; empty tables give no rows. Other columns are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [docs.select(doc_id).schema[0], items.select(item_id).schema[0]]) + ", n_grams bigint"

    def scanner(shared: Broadcast):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                ids, found, counts = [], [], []
                for at, t in enumerate(batch.column("_text")):
                    words = words_of(t.as_py() or "")
                    if len(words) < n:
                        continue
                    for item, starts in known.hits(words).items():
                        ids.append(at)
                        found.append(item)
                        counts.append(len(starts))
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(ids, pa.int64())), pa.array(found, item_type), pa.array(counts, pa.int64())], names=[doc_id, item_id, "n_grams"])

        return scan

    item_type = _arrow_type(items, item_id)
    source = docs.select(F.col(doc_id).alias("_k"), F.col(text).alias("_text"))
    return reduce(DataFrame.unionByName, [source.mapInArrow(scanner(b), schema) for b in _blocks(items, item_id, item_text, n, max_item_chars)])


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.select(column).schema[0].dataType)


def _mapped(text: str) -> tuple[str, list[int]] | None:
    """The normalised text and, for each of its characters, the place in ``text`` it comes from; None where the text does not
    normalise piece by piece."""
    parts, where, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        piece = _DROP.sub("", unicodedata.normalize("NFKC", text[i:j]))
        parts.append(piece)
        where += [i] * len(piece)
        i = j
    flat = "".join(parts)
    keep = [True] * len(flat)
    for m in _BREAK.finditer(flat):
        keep[m.start() : m.end()] = [False] * (m.end() - m.start())
    out, at = [], []
    for c, w, k in zip(flat, where, keep):
        if k:
            low = c.lower()
            out.append(low)
            at += [w] * len(low)
    joined = "".join(out)
    return (joined, at) if joined == normalise(text) else None


def _merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, end) with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def leaked_spans(words: Sequence[str], items: Items) -> list[tuple[int, int]]:
    """The spans [first, end) of words that repeat an item."""
    return _merged([(j, j + items.n) for starts in items.hits(words).values() for j in starts])


def cut_spans(text: str, words: Sequence[str], spans: Sequence[tuple[int, int]], max_share: float) -> str | None:
    """The text without the spans of its words; None if they are more than ``max_share`` of the words, or can't be placed."""
    if not spans:
        return text
    if sum(b - a for a, b in spans) > max_share * len(words) or (mapped := _mapped(text)) is None:
        return None
    flat, at = mapped
    places = [m.span() for m in _WORD.finditer(flat)]
    out, last = [], 0
    for a, b in spans:
        start, end = at[places[a][0]], at[places[b - 1][1]] if places[b - 1][1] < len(at) else len(text)
        out.append(text[last:start])
        last = end
    return "".join([*out, text[last:]])


def cut_leaks(text: str, items: Items, max_share: float) -> tuple[str | None, int]:
    """The text without the leaked spans (see ``cut_spans``) and the number of spans."""
    words = words_of(text)
    spans = leaked_spans(words, items)
    return cut_spans(text, words, spans, max_share), len(spans)


def remove_leaks(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "item_text", n: int = WORDS, max_share: float = 0.5, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """All documents: the columns ``keep``, the text without leaked spans (null where the document is to be dropped because more than
    ``max_share`` of its words leaked), ``n_spans`` and ``action`` ('kept', 'cut' or 'dropped'). A null text stays null and is kept;
    repeated rows are treated alike; empty tables give no rows, and without items every document is kept.

    Each block of items adds its spans in a pass of its own over the row, without a shuffle; the last one cuts."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    spans_type = pa.list_(pa.int64())

    def marker(shared: Broadcast):
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                out = []
                for t, before in zip(batch.column("_text"), batch.column("_spans").to_pylist()):
                    here = leaked_spans(words_of(t.as_py() or ""), known)
                    both = _merged([*zip(before[::2], before[1::2]), *here]) if here else None
                    out.append(before if both is None else [x for s in both for x in s])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("_text"), pa.array(out, spans_type)], names=[*keep, "_text", "_spans"])

        return mark

    def cutter(shared: Broadcast):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                out, spans_of = [], []
                for t, before in zip((x.as_py() for x in batch.column("_text")), batch.column("_spans").to_pylist()):
                    words = words_of(t or "")
                    spans = _merged([*zip(before[::2], before[1::2]), *leaked_spans(words, known)])
                    spans_of.append(len(spans))
                    out.append(None if t is None else cut_spans(t, words, spans, max_share))
                action = ["kept" if not s else "dropped" if t is None else "cut" for t, s in zip(out, spans_of)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string()), pa.array(spans_of, pa.int32()), pa.array(action, pa.string())], names=[*keep, text, "n_spans", "action"])

        return cut

    blocks = _blocks(items, item_id, item_text, n, max_item_chars)
    if len(blocks) > 1:  # only items that leak at all need to be looked for again
        leaking = find_leaks(docs, items, keep[0], text, item_id, item_text, n, max_item_chars).select(item_id).distinct()
        blocks = _blocks(items.join(materialize(leaking, "leaking"), item_id, "leftsemi"), item_id, item_text, n, max_item_chars)
    rows = docs.select(*keep, F.col(text).alias("_text"), F.array().cast("array<bigint>").alias("_spans"))
    for b in blocks[:-1]:
        rows = rows.mapInArrow(marker(b), f"{kept}, _text string, _spans array<bigint>")
    return rows.mapInArrow(cutter(blocks[-1]), f"{kept}, `{text}` string, n_spans int, action string")
