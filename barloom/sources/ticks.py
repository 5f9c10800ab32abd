"""Tick and bar tables: reading, checking, writing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.shared import small_side

TICK_SCHEMA = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])


def read_tick_csv(spark: SparkSession, paths: Sequence[str], header: bool = True, schema: T.StructType = TICK_SCHEMA) -> DataFrame:
    """Ticks of CSV files with a ``seq`` that orders them by file (in the order given) and row. Files are split and read in parallel: seq
    is a sortable struct of the file's number, the split's offset and the row in the split."""
    wrong = "_malformed"
    full = T.StructType([*schema.fields, T.StructField(wrong, T.StringType())])
    rows = spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", wrong).csv(list(paths))
    name = F.col("_metadata.file_path")
    # The whole path, as the file system writes it; a folder stands for its files.
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(name, r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
    number = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(paths))):
        full = "/" + re.sub("^[a-z0-9]+:/*", "", p).strip("/") if re.match("^([a-z0-9]+:)?/", p) else None
        here = (plain == full) | plain.startswith(full + "/") if full else plain.endswith("/" + p.removeprefix("./").strip("/"))
        number = F.when(here, F.lit(i)).otherwise(number)
    return rows.select(*schema.names, wrong, F.struct(F.coalesce(number, F.lit(len(paths))).alias("file"), name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))


def read_raw_tick_text(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``ticker, per, date (yyyymmdd), time, price, volume``, the time padded to six digits: ticker, ts, price, volume."""
    rows = spark.read.schema("ticker string, per string, date string, time string, price double, volume double").option("header", True).csv(path)
    moment = F.try_to_timestamp(F.concat(F.col("date"), F.lpad(F.trim("time"), 6, "0")), F.lit("yyyyMMddHHmmss"))
    return rows.select("ticker", moment.alias("ts"), "price", "volume")


def check_ticks(df: DataFrame, required: Sequence[tuple[str, str]] = (("ts", "timestamp"), ("price", "double"), ("volume", "double"))) -> DataFrame:
    """``df`` if it has the tick columns with their types, else an error. No data is read."""
    kinds = dict(df.dtypes)
    for name, kind in required:
        if name not in kinds:
            raise ValueError(f"column {name} is missing")
        if kinds[name] != kind and not (kind == "double" and kinds[name] in ("float", "int", "bigint", "decimal")):
            raise ValueError(f"column {name} is {kinds[name]}, not {kind}")
    return df


def write_bars(bars: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), append: bool = False) -> None:
    """Write a bar table as parquet or CSV (one header per file), partitioned by ``by``; ``append`` adds it to what is there."""
    writer = bars.write.mode("append" if append else "overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", True).format(kind).save(path)


def csv_to_parquet(spark: SparkSession, pattern: str, out: str, schema: T.StructType) -> None:
    """All CSV files of a pattern into one parquet table."""
    spark.read.schema(schema).option("header", True).csv(pattern).write.mode("overwrite").parquet(out)


def _csv_text(c: Column) -> Column:
    """A CSV field: quoted where it must be, with escapes by backslash as Spark's CSV has them; a null is empty."""
    c = c.cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.coalesce(F.when(c.rlike(r'["\\,\r\n]|^\s|\s$') | (c == ""), quoted).otherwise(c), F.lit(""))


def write_panel(rows: DataFrame, path: str, ts: str, security: str, value: str) -> None:
    """Long rows as a wide CSV frame: a line per ``ts``, a column per security, a header in each file. Lines are made as text, so that no plan has a column per
    security; a line and the names, which are the header, must fit a task and the driver. Of rows with one ts and security the least text counts."""
    cells = rows.select(F.col(ts).alias("_ts"), F.col(security).alias("_security"), F.col(value).alias("_value")).where("_security is not null")
    names = [r[0] for r in cells.select("_security").distinct().orderBy("_security").select(_csv_text(F.col("_security"))).collect()]
    header, n = ",".join([ts, *names]), len(names)
    places = small_side(rows.sparkSession.createDataFrame(list(enumerate(names, 1)), "_at int, _name string"))
    cells = cells.select("_ts", _csv_text(F.col("_security")).alias("_name"), _csv_text(F.col("_value")).alias("_text")).join(places, "_name")
    cells = cells.groupBy("_ts").agg(F.sort_array(F.collect_list(F.struct("_at", "_text"))).alias("_c"))
    cells = cells.withColumn("_c", F.filter("_c", lambda x, i: (i == 0) | (x["_at"] != F.get(F.col("_c"), i - 1)["_at"])))
    placed = F.transform("_c", lambda x, i: F.concat(F.repeat(F.lit(","), x["_at"] - F.when(i > 0, F.get(F.col("_c"), i - 1)["_at"]).otherwise(0)), x["_text"]))
    lines = cells.select(F.concat(_csv_text(F.col("_ts")), F.array_join(placed, ""), F.repeat(F.lit(","), F.lit(n) - F.element_at("_c", -1)["_at"])).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if batch.num_rows and first:
                yield pa.RecordBatch.from_pydict({"value": [header]})
                first = False
            yield batch

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


_QUOTED = re.compile(r'"((?:[^"\\]|\\.|"")*)"(?=,|$)')


def _fields(line: str) -> list[str]:
    """The fields of a CSV line; in quotes a quote is doubled or follows a backslash."""
    if '"' not in line:
        return line.split(",")
    out, at = [], 0
    while at <= len(line):
        if m := _QUOTED.match(line, at):
            out.append(re.sub(r'\\(["\\])|""', lambda x: x[1] or '"', m[1]))
            at = m.end() + 1
        else:
            end = line.find(",", at) if "," in line[at:] else len(line)
            out.append(line[at:end])
            at = end + 1
    return out


def _names(header: str) -> list[str]:
    """The columns of a header, named as Spark's CSV does: an empty one by its place, equal ones with their places."""
    names = _fields(header)
    often = Counter(names)
    return [f"_c{i}" if not x else f"{x}{i}" if often[x] > 1 else x for i, x in enumerate(names)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of CSV files that aren't blank, with their file; ``_head`` marks the first of each file."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            heads = []
            for here in zip(batch.column("_file").to_pylist(), batch.column("_from").to_pylist()):
                heads.append(here != last and here[1] == 0)
                last = here
            yield pa.RecordBatch.from_arrays([batch.column("_file"), batch.column("_line"), pa.array(heads, pa.bool_())], names=["_file", "_line", "_head"])

    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    text = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.col("value").alias("_line"))
    return text.mapInArrow(marked, "_file string, _line string, _head boolean")


def read_panels(spark: SparkSession, paths: dict[str, str], ts: str = "ts") -> DataFrame:
    """Wide CSV frames (a row per date, a column per security), one per quantity, as long rows: ts, security and a column for each quantity; only rows that all frames
    have. Frames are joined by date, a line each, and the joined lines cut into cells, so that no plan has a column per security."""
    heads: list[dict[str, tuple[int, list[str]]]] = []
    dates = None
    for k, path in enumerate(paths.values()):
        lines, own = _lines(spark, path), {}
        for r in lines.where("_head").groupBy("_line").agg(F.collect_set("_file").alias("files")).collect():
            names = _names(r["_line"])
            if ts not in names:
                raise ValueError(f"column {ts} is missing")
            own |= {f: (names.index(ts), names) for f in r.files}
        heads.append(own)

        def dated(batches: Iterator[pa.RecordBatch], at: dict[str, int] = {f: i for f, (i, _) in own.items()}, k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(batch.column("_file").to_pylist(), batch.column("_line").to_pylist())
                days = [x[at[f]] if len(x := _fields(r) if '"' in r else r.split(",", at[f] + 1)) > at[f] else None for f, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([d or None for d in days], pa.string()), batch.column("_file"), batch.column("_line")], names=["_ts", f"_file{k}", f"_line{k}"])

        one = lines.where("not _head").select("_file", "_line").mapInArrow(dated, f"_ts string, _file{k} string, _line{k} string")
        dates = one if dates is None else dates.join(one, "_ts")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[pa.Array, list[list[int]]]] = {}

        def common(files: tuple) -> tuple[pa.Array, list[list[int]]]:
            """The securities that these files share, and their places in each."""
            if files not in known:
                places = [{x: j for j, x in enumerate(names) if j != i} for i, names in (own[f] for own, f in zip(heads, files))]
                shared = [x for x in places[0] if all(x in p for p in places[1:])]
                known[files] = pa.array(shared, pa.string()), [[p[x] for x in shared] for p in places]
            return known[files]

        for batch in batches:
            for row in range(batch.num_rows):
                files = tuple(batch.column(f"_file{k}")[row].as_py() for k in range(len(heads)))
                securities, places = common(files)
                columns = [pa.array([batch.column("_ts")[row].as_py()] * len(securities), pa.string()), securities]
                for k, place in enumerate(places):
                    values = _fields(batch.column(f"_line{k}")[row].as_py())
                    values += [""] * (len(heads[k][files[k]][1]) - len(values))
                    columns.append(pa.array([values[j] or None for j in place], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = ["_ts", "_security", *[f"_v{k}" for k in range(len(heads))]]
    out = dates.mapInArrow(cells, ", ".join(f"{x} string" for x in out_names))
    return out.select(F.col("_ts").alias(ts), F.col("_security").alias("security"), *[F.col(f"_v{k}").cast("double").alias(q) for k, q in enumerate(paths)])


def join_panels(panels: dict[str, DataFrame], ts: str = "ts", security: str = "security") -> DataFrame:
    """Long tables (ts, security, <value>) of several quantities side by side, as the ETF trick reads them; only rows that all have."""
    out = None
    for name, df in panels.items():
        one = df.select(ts, security, F.col("value").alias(name))
        out = one if out is None else out.join(one, [ts, security])
    return out
