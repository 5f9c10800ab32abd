"""Text records: the grammar, reasons and typed values."""

import datetime as dt
import random

from barloom.sources.records import loaded, parse_records, rejected

GOOD = "A,2020-02-29 13:30:24,1,2.5,3.0,2.0,2.75,100,40,7,275.5"
SCHEMA = "record_id long, feed_file string, line_no int, raw_line string, close string"


def change(i, value):
    f = GOOD.split(",")
    f[i] = value
    return ",".join(f)


CASES = [
    (GOOD, True), (None, False), ("", False), (GOOD + "\r", True), (GOOD + "\r\r", True), (GOOD + ",", False), (GOOD.rsplit(",", 1)[0], False),
    (change(0, '"A, ""b""\nc"'), True), (change(0, '"A'), False), (change(0, 'A"'), False), (change(0, '"A"x'), False), (change(0, '"A" '), False), (change(0, ' "A"'), False), (change(0, '""'), True), (change(0, "line\nbreak"), True),
    (change(1, "2020-02-30 00:00:00"), False), (change(1, "2021-02-29 00:00:00"), False), (change(1, "2020-02-29T23:59:59.123456"), True), (change(1, "2020-02-29 24:00:00"), False), (change(1, "2020-02-29 23:60:00"), False), (change(1, "0000-01-01 00:00:00"), False), (change(1, "0001-01-01 00:00:00"), True),
    (change(1, "  2020-02-29 00:00:00  "), True), (change(1, "2020-02-29 00:00:00."), False), (change(1, "2020-02-29 00:00:00.1234567"), False), (change(1, "2020-02-29 00:00:00Z"), False), (change(1, "2020-2-29 00:00:00"), False), (change(1, '"2020-02-29 00:00:00"'), True), (change(1, ""), False), (change(1, "2020-02-29  00:00:00"), False),
    (change(6, "0"), False), (change(6, "-1"), False), (change(6, "+1"), True), (change(6, "1."), True), (change(6, ".5"), True), (change(6, "."), False), (change(6, "1e3"), True), (change(6, "1e9"), False), (change(6, "999999999.9"), True), (change(6, "1e400"), False), (change(6, "1e-400"), True), (change(6, "0e5"), False),
    (change(6, " 7 "), True), (change(6, '" 7 "'), True), (change(6, '"1,000"'), False), (change(6, "١"), False), (change(6, "NaN"), False), (change(6, "inf"), False), (change(6, "1_0"), False), (change(6, "5%"), False), (change(6, ""), False), (change(6, "999999999.99999999999"), True),
    (change(7, "n/a"), True), (change(3, ""), True), ("﻿" + GOOD, True), (GOOD.replace(",", "\t"), False), (GOOD + GOOD, False), (change(0, ""), True), (change(0, '"' + "y" * 3_000_000 + '"'), True),
]


def test_grammar(spark):
    df = spark.createDataFrame([(i, "f", i, t, "x") for i, (t, _) in enumerate(CASES)] + [(0, "f", 0, GOOD, "x")], SCHEMA)
    parsed = parse_records(df)
    bad = {r.record_id: r.reason for r in rejected(parsed).collect()}
    for i, (t, ok) in enumerate(CASES):
        assert (i not in bad) == ok, (t and t[:200], bad.get(i))
    assert "fields instead of 11" in bad[[t for t, _ in CASES].index(GOOD + ",")] and bad[1] == "record is null"
    good = {r.record_id: r for r in loaded(parsed).where("length(instrument_name) < 100 and year(date_time) > 1").collect()}
    assert good[0].date_time == dt.datetime(2020, 2, 29, 13, 30, 24) and good[0].close == 2.75 and good[0].tick_num == 1.0
    assert good[[t for t, _ in CASES].index(change(0, '"A, ""b""\nc"'))].instrument_name == 'A, "b"\nc'
    assert good[[t for t, _ in CASES].index(change(7, "n/a"))].volume is None
    assert loaded(parsed).count() + len([1 for _, ok in CASES if not ok]) == len(CASES) + 1  # the repeated record loads again


def test_private_characters_stay(spark):
    every = "".join(chr(c) for c in range(0xE000, 0xF900))
    names = [every, "\ue000n\ue000r\ue000e\ue000", '"\ue000\nn\ue000e\r"']
    df = spark.createDataFrame([(i, "f", i, change(0, n), "x") for i, n in enumerate(names)], SCHEMA)
    out = {r.record_id: r.instrument_name for r in loaded(parse_records(df)).collect()}
    assert out == {0: every, 1: names[1], 2: names[2].strip('"')}


def test_kept_column_that_clashes(spark):
    df = spark.createDataFrame([(1, "f", 1, GOOD, "mine")], SCHEMA)
    row = parse_records(df, keep=("record_id", "close")).first()
    assert row.close == "mine" and row.close_value == 2.75
    assert parse_records(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fields(t):
    """The grammar, a character at a time; None where quoting is broken."""
    t = t[:-1] if t.endswith("\r") else t
    fields, i = [], 0
    while True:
        if t[i : i + 1] == '"':
            i += 1
            out = ""
            while True:
                j = t.find('"', i)
                if j < 0:
                    return None
                out += t[i:j]
                if t[j : j + 2] == '""':
                    out += '"'
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < len(t) and t[i] != ",":
                return None
        else:
            j = t.find(",", i)
            out = t[i : len(t) if j < 0 else j]
            if '"' in out:
                return None
            i += len(out)
        fields.append(out)
        if i >= len(t):
            return fields
        i += 1


def test_random_records_against_a_plain_parser(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(800):
        f = [rng.choice(["a", "", '"q"', '"a,b"', '"x""y"', "z z", '"\n"', "p\r"]) for _ in range(rng.choice([10, 11, 11, 11, 12]))]
        if len(f) > 6:
            f[1], f[6] = "2020-01-01 00:00:00", "1.5"
        t = ",".join(f)
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(['"', ",", "\n", ""]) + t[k + 1 :]
        texts.append(t)
    df = spark.createDataFrame([(i, "f", i, t, "") for i, t in enumerate(texts)], SCHEMA)
    parsed = {r.record_id: r for r in parse_records(df).collect()}
    for i, t in enumerate(texts):
        fields = brute_fields(t)
        r = parsed[i]
        if fields is None:
            assert r.reason == "broken quoting", t
        elif len(fields) != 11:
            assert r.reason == f"{len(fields)} fields instead of 11", t
        elif r.reason is None:
            assert r.instrument_name == fields[0], t
