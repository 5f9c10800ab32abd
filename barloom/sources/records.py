"""Text records into typed rows, the failed ones kept apart with the reason.

Method: each Arrow batch of records goes through pyarrow's CSV reader with an invalid-row callback that collects structural
rejects; all fields are read as strings, then dates and numbers are cast as vectors and failing cells labelled. Quoting is
tested first against the record grammar, because the CSV reader is more lenient than it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_FIELDS = ("instrument_name", "date_time", "tick_num", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks", "cum_dollar_value")
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
#: Quoting: fields by the grammar, any number of them.
_QUOTING = rf"(?s)\A{_FIELD}(?:,{_FIELD})*\z"
_MOMENT = r"\A *(?P<y>[0-9]{4})-(?P<mo>[0-9]{2})-(?P<d>[0-9]{2})[ T](?P<h>[0-9]{2}):(?P<mi>[0-9]{2}):(?P<s>[0-9]{2})(?:\.(?P<f>[0-9]{1,6}))? *\z"
_DECIMAL = r"\A *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *\z"


@dataclass(frozen=True)
class RecordFormat:
    """Names of the fields in order; of these the moments and the positive numbers (below ``below``) that must be usable."""

    fields: Sequence[str] = BAR_FIELDS
    moments: Sequence[str] = ("date_time",)
    positive: Sequence[str] = ("close",)
    below: float = 1e9
    lenient: Sequence[str] = field(default=("tick_num", "open", "high", "low", "volume", "cum_buy_volume", "cum_ticks", "cum_dollar_value"))


#: Stands before a letter for a line break, so that the reader can split by lines; itself written with a letter too.
_MARK = "\ue000"
_ESCAPES = ((_MARK, _MARK + "e"), ("\r", _MARK + "r"), ("\n", _MARK + "n"))


def _moments(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Epoch microseconds, and which of the values are existing moments."""
    parts = pc.extract_regex(values, _MOMENT)
    ok = np.asarray(parts.is_valid())

    def number(name: str) -> np.ndarray:
        text = pc.struct_field(parts, name)
        return np.asarray(pc.cast(pc.if_else(pc.fill_null(pc.not_equal(text, ""), False), text, "0"), pa.int64()))

    y, mo, d, h, mi, s = (number(n) for n in ("y", "mo", "d", "h", "mi", "s"))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 0, 12)] + (leap & (mo == 2))
    ok &= (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= length) & (h <= 23) & (mi <= 59) & (s <= 59)
    fraction = pc.fill_null(pc.struct_field(parts, "f"), "")
    micros = np.asarray(pc.cast(pc.utf8_rpad(pc.if_else(pc.equal(fraction, ""), "0", fraction), 6, "0"), pa.int64()))
    # Days from civil date, years from March.
    yy, mm = y - (mo <= 2), (mo + 9) % 12
    era, yoe = yy // 400, yy % 400
    days = era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + (153 * mm + 2) // 5 + d - 1 - 719468
    return ((days * 24 + h) * 60 + mi) * 60_000_000 + s * 1_000_000 + micros, ok


def _decimals(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (NaN where unusable), and which of the values are decimal numbers in ASCII digits."""
    ok = np.asarray(pc.fill_null(pc.match_substring_regex(values, _DECIMAL), False))
    text = pc.ascii_trim(pc.if_else(pa.array(ok), values, "nan"), " ")
    plain = pc.replace_substring_regex(text, r"\A\+", "")
    return np.asarray(pc.cast(plain, pa.float64())), ok


def _positive(values: pa.Array, below: float) -> tuple[np.ndarray, np.ndarray]:
    number, ok = _decimals(values)
    with np.errstate(invalid="ignore"):
        good = ok & (number > 0) & (number < below)
        for i in np.flatnonzero(ok & ((number == 0) | (number == below))):  # rounding may have moved it onto the edge
            try:
                good[i] = 0 < Decimal(values[int(i)].as_py().strip(" ")) < Decimal(below)
            except InvalidOperation:
                good[i] = float(number[i]) == 0 and any(c in "123456789" for c in values[int(i)].as_py().lower().split("e")[0])
    return number, good


def _split(text: pa.Array, names: Sequence[str]) -> tuple[np.ndarray, dict[int, int], pa.Table]:
    """Indexes of the records that split into the fields; field counts of those that don't; the fields as strings."""
    flat = text
    for raw, escaped in _ESCAPES:
        flat = pc.replace_substring(flat, raw, escaped)
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(text))), pa.string()), flat, ",")
    wrong: dict[int, int] = {}

    def reject(row: pacsv.InvalidRow) -> str:
        wrong[int(row.text.split(",", 1)[0])] = row.actual_columns - 1
        return "skip"

    columns = ["_row", *names]
    body = "\n".join(numbered.to_pylist()).encode() + b"\n"
    longest = max(pc.max(pc.binary_length(numbered)).as_py() or 0, 1)
    table = pacsv.read_csv(
        io.BytesIO(body), pacsv.ReadOptions(column_names=columns, use_threads=False, block_size=max(1 << 20, 2 * longest + 1024)),
        pacsv.ParseOptions(invalid_row_handler=reject, ignore_empty_lines=False),
        pacsv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=False, check_utf8=False),
    ).combine_chunks()
    back = [table[c].combine_chunks() for c in names]
    for raw, escaped in reversed(_ESCAPES):
        back = [pc.replace_substring(c, escaped, raw) for c in back]
    return np.asarray(pc.cast(table["_row"].combine_chunks(), pa.int64())), wrong, pa.table(back, names=list(names))


def parse_batch(text: pa.Array, fmt: RecordFormat) -> tuple[list[str | None], dict[str, pa.Array]]:
    """For each record the reason of its failure (null if it loads), and the typed fields (null where a record failed)."""
    n = len(text)
    reason: list[str | None] = [None] * n
    text = text.cast(pa.string()).combine_chunks() if isinstance(text, pa.ChunkedArray) else text.cast(pa.string())
    given = np.asarray(text.is_valid())
    clean = pc.replace_substring_regex(pc.fill_null(text, ""), r"\r\z", "")
    quoted = np.asarray(pc.match_substring_regex(clean, _QUOTING))
    for i in np.flatnonzero(~given):
        reason[i] = "record is null"
    for i in np.flatnonzero(given & ~quoted):
        reason[i] = "broken quoting"
    split = np.flatnonzero(given & quoted)
    out_rows, fields = np.zeros(0, dtype=int), pa.table({c: pa.array([], pa.string()) for c in fmt.fields})
    if len(split):
        rows, wrong, fields = _split(clean.take(pa.array(split)), fmt.fields)
        for i, count in wrong.items():
            reason[split[i]] = f"{count} fields instead of {len(fmt.fields)}"
        out_rows = split[rows]
    good = np.ones(len(out_rows), dtype=bool)
    cells: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for c in fmt.moments:
        cells[c] = _moments(fields[c].combine_chunks())
    for c in fmt.positive:
        cells[c] = _positive(fields[c].combine_chunks(), fmt.below)
    for c in (*fmt.moments, *fmt.positive):
        for i in np.flatnonzero(good & ~cells[c][1]):
            reason[out_rows[i]] = f"unusable {c}: {fields[c][int(i)].as_py()[:100]}"
        good &= cells[c][1]
    place = np.full(n, -1)
    place[out_rows[good]] = np.flatnonzero(good)
    at = pa.array(np.where(place < 0, 0, place), mask=place < 0)
    typed: dict[str, pa.Array] = {}
    for c in fmt.fields:
        if c in fmt.moments:
            values = pa.array(cells[c][0], pa.timestamp("us", "UTC")) if len(out_rows) else pa.array([], pa.timestamp("us", "UTC"))
        elif c in fmt.positive:
            values = pa.array(cells[c][0], pa.float64())
        elif c in fmt.lenient:
            number, ok = _decimals(fields[c].combine_chunks())
            values = pa.array(number, pa.float64(), mask=~ok)
        else:
            values = fields[c].combine_chunks()
        typed[c] = values.take(at) if len(values) else pa.nulls(n, values.type)
    return reason, typed


def parse_records(df: DataFrame, text: str = "raw_line", keep: Sequence[str] = ("record_id", "feed_file", "line_no"), fmt: RecordFormat = RecordFormat()) -> DataFrame:
    """One row per record: the columns ``keep``, ``reason`` (null: the record loads) and the typed fields (null where it failed).

    Grammar: comma-separated fields; a field that begins with a double quote ends at the next single one, which a comma or the
    record's end must follow, and inside it two stand for one and commas and line breaks are content; another field holds
    none. One carriage return at the end is ignored. Moments are yyyy-MM-dd HH:mm:ss with a blank or T between and up to six
    decimals; blanks around moments and numbers are ignored. Other numeric fields may hold anything and are null where they
    are no number. A null or empty record fails; repeated records load again; a field whose name clashes with a kept column
    is named ``<field>_value``. An empty table gives no rows. One pass, no shuffle; records that load and that fail come from
    the same scan: filter on ``reason``.
    """
    names = {c: f"{c}_value" if c in keep else c for c in fmt.fields}
    kinds = {c: "timestamp" if c in fmt.moments else "double" if c in (*fmt.positive, *fmt.lenient) else "string" for c in fmt.fields}
    source = df.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{kept}, reason string, " + ", ".join(f"`{names[c]}` {kinds[c]}" for c in fmt.fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reason, typed = parse_batch(batch.column("_text"), fmt)
            arrays = [*[batch.column(c) for c in keep], pa.array(reason, pa.string()), *[typed[c] for c in fmt.fields]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "reason", *[names[c] for c in fmt.fields]])

    return source.mapInArrow(parse, schema)


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame, keep: Sequence[str] = ("record_id", "feed_file", "line_no")) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(*keep, "reason")
