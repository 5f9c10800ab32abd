"""Splitting oversized texts at natural boundaries.

Method: content-defined chunking. A rolling hash over token ids marks landmarks that depend on nearby content only; a piece
ends at the first landmark behind its least size, moved to the nearest natural boundary (paragraph, claim or sentence)
within the least and the largest size. An edit therefore moves only the cuts near it. Consecutive pieces share a fixed
number of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import VOCABULARY, encoder, ship_vocabulary, token_bytes

#: Ends of paragraphs and of lines before a numbered claim, paragraph or heading.
_STRONG = re.compile(rb"\n[ \t\r]*\n\s*|\n(?=[ \t]*(?:\[?\d{1,4}[\].)]|#|[A-Z][A-Z ]{4,}\n))")
#: Ends of sentences, western and Chinese, and other line breaks.
_WEAK = re.compile(rb"[.!?;:][\"')\]]?(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b|\n")


@dataclass(frozen=True)
class Limits:
    """``least``: fewest tokens that a piece adds; ``landmark``: one token in so many is a landmark; ``span``: tokens a landmark's hash covers."""

    largest: int = 1536
    overlap: int = 128
    least: int = 768
    landmark: int = 256
    span: int = 8

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.largest - self.overlap - 4 or self.overlap < 0:
            raise ValueError("least and overlap must fit into largest")


def _rolling(ids: np.ndarray, span: int) -> np.ndarray:
    """Hash of the ``span`` tokens before each place between tokens (0: start of the text)."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(len(ids) + 1, dtype=np.uint64)
        for k in range(span):
            part = mixed[: len(ids) - k] * np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64))
            h[k + 1 :] += part
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)


def split(text: str, limits: Limits = Limits(), vocabulary: str = VOCABULARY) -> list[tuple[int, int, str, str]]:
    """Pieces of a text over the limit as (first token, end token, boundary of the end, text); none for a text within it."""
    raw = text.encode()
    if len(raw) <= limits.largest:  # a token has at least one byte
        return []
    enc = encoder(vocabulary)
    ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
    n = len(ids)
    if n <= limits.largest:
        return []
    at = np.concatenate([[0], np.cumsum(token_bytes(vocabulary)[ids])])  # byte of each place between tokens
    data = np.frombuffer(raw, dtype=np.uint8)
    whole = np.ones(n + 1, dtype=bool)  # places that cut no character
    whole[:-1] = (data[at[:-1]] & 0xC0) != 0x80
    places = np.flatnonzero(whole)

    def natural(pattern: re.Pattern[bytes]) -> np.ndarray:
        ends = np.fromiter((m.end() for m in pattern.finditer(raw)), dtype=np.int64)
        return np.unique(places[np.minimum(np.searchsorted(at[places], ends), len(places) - 1)])

    strong, weak = natural(_STRONG), natural(_WEAK)
    marks = places[_rolling(ids, limits.span)[places] % np.uint64(limits.landmark) == 0]

    def within(xs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return xs[np.searchsorted(xs, lo) : np.searchsorted(xs, hi, "right")]

    def cut(lo: int, hi: int) -> tuple[int, str]:
        m, s, w = within(marks, lo, hi), within(strong, lo, hi), within(weak, lo, hi)
        goal = int(m[0]) if len(m) else hi
        best = min(((abs(int(x) - goal) * weight, int(x), kind) for xs, weight, kind in ((s, 1, "paragraph"), (w, 2, "sentence")) for x in xs), default=None)
        if best:
            return best[1], best[2]
        return (goal, "landmark") if len(m) else (int(within(places, lo, hi)[-1]), "none")

    pieces, start, new = [], 0, 0
    while True:
        room = limits.largest
        while True:
            if n - start <= room:
                end, kind = n, "end"
            else:
                end, kind = cut(min(new + limits.least, start + room - 4), start + room)
            piece = raw[at[start] : at[end]].decode()
            size = len(enc.encode_ordinary(piece))
            if size <= limits.largest:  # on its own a piece may take other tokens at its ends
                break
            room = min(room, end - start) - max(size - limits.largest, 1)
        pieces.append((start, end, kind, piece))
        if end == n:
            return pieces
        new = end
        start = int(places[np.searchsorted(places, end - limits.overlap, "right") - 1])


def split_documents(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", limits: Limits = Limits(), vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every text of more than ``limits.largest`` tokens, in order: the columns ``keep``, ``piece`` (from 0), ``n_pieces``,
    ``first_token``, ``end_token``, ``shared_tokens`` (with the piece before), ``boundary`` (what the piece ends at: 'paragraph', 'sentence',
    'landmark', 'none' or 'end') and ``piece_text``.

    Every piece, encoded on its own, has at most ``largest`` tokens; it shares ``overlap`` tokens with the one before, up to three
    more where the overlap would begin inside a character. Texts within the limit, null and empty ones give no piece;
    repeated rows are split again. Texts are processed whole, each by one task; no shuffle.
    """
    ship_vocabulary(df.sparkSession, vocabulary)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{kept}, piece int, n_pieces int, first_token bigint, end_token bigint, shared_tokens int, boundary string, piece_text string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("_text")):
                pieces = split(t.as_py() or "", limits, vocabulary)
                before = 0
                for k, (a, b, kind, piece) in enumerate(pieces):
                    rows.append(i)
                    out.append((k, len(pieces), a, b, before - a if k else 0, kind, piece))
                    before = b
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*keep, "piece", "n_pieces", "first_token", "end_token", "shared_tokens", "boundary", "piece_text"])

    # A token has at least one byte, so shorter texts are within the limit.
    source = df.where(F.octet_length(text) > limits.largest).select(*keep, F.col(text).alias("_text"))
    return source.mapInArrow(scan, schema)
