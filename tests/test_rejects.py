from arborix.sources import rejects as R

GOOD = ["f", "s", "c", "g", "q", "src", "exon", "10", "20", "+", ".", "i", "n", "p", "ps", "own", "ID=i"]


def line(**change):
    names = [f.name for f in R.FEATURE_FIELDS]
    return "\t".join(change.get(n, v) for n, v in zip(names, GOOD))


CASES = [
    (line(), []),
    (line() + "\r", []),
    (line(attrs="a\r"), []),
    (line(attrs="x") + "\r\r", []),
    (line(start=" 007 "), []),
    (line(start="0" * 40 + "7"), []),
    (line(start="9223372036854775807", end="9223372036854775807"), []),
    (line(start="9223372036854775808"), ["start_value"]),
    (line(start="0"), ["start_value"]),
    (line(start="+5", end=""), ["start_value", "end_value"]),
    (line(start="１０"), ["start_value"]),
    (line(start=" 10"), ["start_value"]),
    (line(start="30"), ["end_before_start"]),
    (line(start="030", strand="*"), ["end_before_start", "strand_value"]),
    (line(strand=" NA "), []),
    (line(strand="?"), []),
    (line(strand=""), ["strand_value"]),
    (line(start='"10"', strand='"+"'), []),
    (line(attrs='"a\tb"'), []),
    (line(attrs='"a ""so"" b"'), []),
    (line(attrs='note="x"'), []),
    (line(attrs='5" over'), []),
    (line(attrs='"a" b'), ["quoting"]),
    (line(attrs='"a'), ["quoting"]),
    ('"' + line(), ["quoting"]),
    (line(start="x") + "\textra", ["column_count"]),
    ("a\tb", ["column_count"]),
    ("a,b", ["column_count"]),
    (line(attrs="a\nb"), []),
    (line(attrs='"' + "y" * 200_000 + '"'), []),
    (line(attrs='"' + 'y""' * 50_000 + '"'), []),
    (line(start="1" * 100_000), ["start_value"]),
    ("\t".join([""] * 16) + "\tx", ["start_value", "end_value", "strand_value"]),
]


def test_lines(spark):
    rows = [(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(900, None, ""), (901, "", ""), (902, "  \t ", ""), (903, "# x", ""), (904, "\r", "")]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reasons string")
    parsed = R.parse_lines(df, "line_id", "raw_line")
    got = {r.record_id: sorted(r.reasons) for r in parsed.select("record_id", "reasons").collect()}
    assert got == {i: sorted(x) for i, (_, x) in enumerate(CASES)}
    assert {r.record_id for r in R.valid_rows(parsed).collect()} == {i for i, (_, x) in enumerate(CASES) if not x}
    typed = {r.record_id: (r.start, r.end, r.strand) for r in R.valid_rows(parsed).select("record_id", "start", "end", "strand").collect()}
    assert typed[4] == (7, 20, "+") and typed[14][2] == "NA"


def test_first_broken_field(spark):
    df = spark.createDataFrame([(1, line(name='"x" y')), (2, "a\tb"), (3, line())], "line_id long, raw_line string")
    got = {r.record_id: r.first_broken for r in R.parse_lines(df, "line_id", "raw_line").collect()}
    assert got == {1: 13, 2: 3, 3: None}


def test_columns(spark):
    names = [f.name for f in R.FEATURE_FIELDS]
    row = dict(zip(names, GOOD))
    cases = [({}, []), ({"start": None}, ["start_value"]), ({"start": "5\t6"}, ["start_value"]), ({"end": "9 "}, ["end_before_start"]), ({"strand": None, "end": "x"}, ["end_value", "strand_value"])]
    rows = [(i, "e", *[{**row, **c}[n] for n in names]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "row_id long, record_id string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.record_id: sorted(r.reasons) for r in R.parse_columns(df, "row_id").select("record_id", "reasons").collect()}
    assert got == {i: sorted(x) for i, (_, x) in enumerate(cases)}
    assert R.failures(R.parse_columns(df.limit(0), "row_id"), "t").count() == 0
