import __spark_entry__
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.operators.records import broken_records, located_faults, read, valid_records

GOOD = 'p0001,p0001r002,3,Speech ,Ana,"a ""b"", c\nd",e,,2024-02-29 10:00:00'
BROKEN = {
    'p0001,p0001r002,3,speech,Ana,say "b",e,,2024-02-29 10:00:00': "quoting",
    'p0001,"a': "quoting",
    '"a"b,c': "quoting",
    "p0001,p0001r002,3,speech": "columns",
    GOOD.replace("29 10", "30 10"): "values",
    GOOD.replace("10:00", "24:00"): "values",
    GOOD.replace("2024-02-29", "2023-02-29"): "values",
    GOOD.replace(",3,", ",03,"): "values",
    GOOD.replace(",e,", ", 　,"): "values",
    GOOD.replace(",e,", ",e\x07,"): "values",
    GOOD.replace(",e,", ",e�,"): "values",
    GOOD.replace("p0001r002", "+Add"): "values",
    GOOD.replace("p0001,", "p000١,"): "values",
    GOOD + "\n": "values",
    None: "columns",
}
VALID = [GOOD, GOOD.replace(",e,,", ",,drop,"), GOOD.replace("p0001r002", "+add1"), GOOD.replace(",e,", ",e\t,"), ",".join(f'"{x}"' for x in ["p0001", "p0001r002", "3", "sfx", "", "a", "b", "", "2024-01-01 00:00:00"])]


def test_p5_is_registered_and_reasons_are_right(spark):
    assert "p5_found" in __spark_entry__.queries()
    lines = [*BROKEN, *VALID]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_key bigint, raw_line string")
    got = {lines[r.raw_key]: r.reason for r in broken_records(df).collect()}
    assert got == BROKEN
    rows = valid_records(df).orderBy("raw_key").collect()
    assert len(rows) == len(VALID)
    assert (rows[0].src, rows[0].kind, rows[0].answer) == ('a "b", c\nd', "speech", None)


def slow_reason(line):
    """The same judgement letter by letter."""
    fields, field, state = [], "", "start"
    for c in line:
        if state == "quoted":
            if c == '"':
                state = "closed"
            else:
                field += c
        elif state == "closed" and c == '"':
            field, state = field + '"', "quoted"
        elif c == ",":
            fields, field, state = [*fields, field], "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        elif c == '"' or state == "closed":
            return "quoting"
        else:
            field, state = field + c, "plain"
    if state == "quoted":
        return "quoting"
    return "columns" if len(fields) != 8 else None


@settings(max_examples=500, deadline=None)
@given(st.text('",a\n', max_size=30))
def test_parser_agrees_with_letter_by_letter(line):
    want = slow_reason(line)
    faults = read(line)[1]
    rank = {"quoting": 0, "columns": 1, "values": 2}
    assert min((f.reason for f in faults), key=rank.get) == (want or "values")


def test_parsing_resumes_at_record_starts(spark):
    cell = 'p0001,p0001r001,1,speech,,"open,b,,2024-01-01 00:00:00\n' + GOOD + "x"[:0]
    rows, faults = read(cell + '\np0009,bad "quote"\n' + GOOD.replace("Ana", "Ben"))
    assert [r["speaker"] for r in rows] == ["Ben"] and [f.reason for f in faults] == ["quoting"]
    df = spark.createDataFrame([(1, 'p0001,p0001r001,1,sfx,a "b" c\n' + GOOD, 1), (2, None, 1), (3, "x," * 50_000, 1)], "raw_key bigint, raw_line string, rows int")
    assert [(r.raw_key, r.record_no, r.speaker) for r in valid_records(df).collect()] == [(1, 2, "Ana")]
    assert {(r.raw_key, r.reason, r.at) for r in located_faults(df).collect()} == {(1, "quoting", 24), (2, "columns", 0), (3, "columns", 0)}
    assert broken_records(df.limit(0)).count() == 0
