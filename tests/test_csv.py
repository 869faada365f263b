"""Folders of CSV files, small and large."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescout import CellSource, build_lake, csv_source, discover_csv, profile, read_csv
from tablescout.plans.lake import export_ranking
from tablescout.plans.profiling import export_profiles
from tablescout.functions.text import TYPE_TESTS
from tablescout.sources import csv_lake
from tablescout.sources.csv_lake import open_after
from tablescout.sources.dialect import Dialect, read_line


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("csvs")
    (d / "people.csv").write_bytes(
        b'\xef\xbb\xbfid,"na""me",joined,ok,score\n1,"Ann, A",2024-01-02,true,1.5\n2,"Bob\nB",2024-01-03,FALSE,007\n'
        b'3,,2024-01-04,true,2e3\n4,too,many,fields,here,now\n'
    )
    (d / "codes.CSV").write_text("code,when\nAA,10:20:30\nBB,11:00:00\nCC,\n")
    (d / "more codes.csv").write_text("kode,ts\n aa ,2024-01-01 00:00:00\nbb,2024-01-01T10:00:00\ndd,2024-01-02 00:00:00.5\n")
    (d / "broken.csv").write_bytes(b"a,b\n\xff\xfe\xfa,1\n")
    (d / "empty.csv").write_text("")
    (d / "header.csv").write_text("a,b\n")
    (d / "notes.txt").write_text("not a table")
    return str(d)


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_discovery(spark, folder):
    names = [r["table_name"] for r in discover_csv(spark, folder).collect()]
    assert names == sorted(names) and len(names) == 6 and "codes.CSV" in names


def test_small_files(spark, folder):
    source = csv_source(spark, folder)
    assert source.skipped == ["broken.csv", "empty.csv", "header.csv"]
    types = rows(source.columns(), "table_name", "column_name", "data_type", "type_class")
    assert types == {
        ("people.csv", "id", "bigint", "numeric"), ("people.csv", "name", "string", "string"),
        ("people.csv", "joined", "date", "date"), ("people.csv", "ok", "boolean", "string"),
        ("people.csv", "score", "double", "numeric"), ("codes.CSV", "code", "string", "string"),
        ("codes.CSV", "when", "time", "date"), ("more codes.csv", "kode", "string", "string"),
        ("more codes.csv", "ts", "timestamp", "date"),
    }
    prof = profile(source)
    people = {r["column_name"]: r for r in prof.column_profile.where(F.col("table_name") == "people.csv").collect()}
    assert people["id"]["row_count"] == 3
    assert people["name"]["freq_word_containment"] == ["ann, a", "bobb"]
    assert (people["score"]["first_word"], people["score"]["last_word"]) == ("1.5", "2000.0")
    assert people["ok"]["freq_word_containment"] == ["true", "false"]
    assert people["ok"]["role"] == "FLAG"
    sample = {r["table_name"]: r["sample_text"] for r in prof.samples.collect()}["codes.CSV"]
    assert sorted(sample.split("\n")[3:]) == ["AA | 10:20:30", "BB | 11:00:00", "CC | "]


AWKWARD = {
    "times.csv": b"t,d,zero\n" + b"".join(b"%02d:10:20,2024-01-%02d,%s\n" % (i % 24, i % 28 + 1, b"0000-00-00" if i % 12 == 0 else b"2024-02-03") for i in range(60)),
    "ids.csv": b"id,wide,real\n" + b"".join(b"90071992547409%05d,12345678901234567890%03d,0.%020d\n" % (i, i, i + 10**19) for i in range(60)),
    "heads.csv": b"a,a,A\n" + b"".join(b"x%d,y%d,z\n" % (i, i % 3) for i in range(40)),
    "latin.csv": b"w,n\n" + b"".join((b"caf\xe9,%d\n" if i % 9 == 4 else b"tea %d,5\n") % i for i in range(45)),
    "breaks.csv": b'id,"te""xt",z\r\n' + b"".join(b'%d,"line, ""one""\n\nand \r\nmore %d",5" pipe\r\n' % (i, i) for i in range(50)) + b'77,"',
}


def all_of(source):
    columns = source.columns().drop("column_id").collect()
    cells = source.cells.select("table_name", "column_pos", "type_class", "v").collect()
    return sorted(columns), sorted(cells, key=repr), source.skipped


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    d = tmp_path_factory.mktemp("awkward")
    for name, raw in AWKWARD.items():
        (d / name).write_bytes(raw)
    return str(d)


@pytest.mark.parametrize("split", [40, 97, 400])
def test_splits_change_nothing(spark, awkward, split):
    expected = all_of(csv_source(spark, awkward))
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert all_of(csv_source(spark, awkward)) == expected
        wide = read_csv(spark, f"{awkward}/breaks.csv").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, wide)) == sorted((i, f'line, "one"\n\nand \r\nmore {i}', '5" pipe') for i in range(50))


def test_types_of_awkward_files(spark, awkward):
    source = csv_source(spark, awkward)
    types = {(r["table_name"], r["column_name"]): r["data_type"] for r in source.columns().collect()}
    assert types == {
        ("times.csv", "t"): "time", ("times.csv", "d"): "date", ("times.csv", "zero"): "string", ("ids.csv", "id"): "bigint",
        ("ids.csv", "wide"): "decimal(38,0)", ("ids.csv", "real"): "string", ("heads.csv", "a"): "string", ("heads.csv", "a_1"): "string",
        ("heads.csv", "A_2"): "string", ("latin.csv", "w"): "string", ("latin.csv", "n"): "string", ("breaks.csv", "id"): "bigint",
        ("breaks.csv", "text"): "string", ("breaks.csv", "z"): "string"}
    profiles = {(r["table_name"], r["column_name"]): r for r in profile(source).column_profile.collect()}
    assert all(profiles["ids.csv", c]["cardinality"] == 60 for c in ("id", "wide", "real"))
    assert profiles["times.csv", "zero"]["non_null"] == 60 and profiles["times.csv", "t"]["role"] == "TEMPORAL"
    assert profiles["latin.csv", "w"]["row_count"] == 40
    wide = {name: dict(read_csv(spark, f"{awkward}/{name}").dtypes) for name in AWKWARD}
    assert wide["times.csv"] == {"t": "string", "d": "date", "zero": "string"}
    assert wide["ids.csv"] == {"id": "bigint", "wide": "decimal(38,0)", "real": "string"}
    assert set(wide["latin.csv"].values()) == {"string"}


@pytest.mark.parametrize("line", [b"a,b", b'"a",b', b'"a,b', b'"a"",b', b'"a""",b', b'a"b,"c', b'"a"b"c,"d"', b'""', b'"', b'a,""",', b'"","",'])
def test_state_after_a_line(line):
    import csv
    import io

    closed = len(list(csv.reader(io.StringIO(line.decode() + "\nx\n")))) == 2
    assert open_after(line, False) is not closed
    inside = len(list(csv.reader(io.StringIO('"' + line.decode() + "\nx\n")))) == 2
    assert open_after(line, True) is not inside


def test_no_files(spark, tmp_path):
    with pytest.raises(ValueError):
        csv_source(spark, str(tmp_path))


def test_lenient_text_reader(spark, folder):
    df = read_csv(spark, f"{folder}/people.csv", as_strings=True)
    assert {t for _, t in df.dtypes} == {"string"} and df.count() == 3


def test_csv_lake(spark, folder, tmp_path):
    lake = build_lake(csv_source(spark, folder), str(tmp_path / "lake"), "codes", "from files")
    assert lake.meta["n_tables"] == 3 and lake.meta["skipped"] == ["broken.csv", "empty.csv", "header.csv"]
    best = lake.search_indexed("codes.CSV").head()
    assert (best["candidate_table"], best["best_query_column"], best["best_candidate_column"]) == (
        "more codes.csv", "code", "kode")
    # Same length ranges, 2 of 4 distinct codes shared: I = (2/4)(3+3)/(1+2/4) = 2 of 3.
    assert best["joinability_score"] == pytest.approx(0.6667)
    unseen = lake.search(f"{folder}/codes.CSV", query_name="codes.CSV").head()
    assert unseen["joinability_score"] == best["joinability_score"]
    assert {r["query_table"] for r in lake.search(f"{folder}/codes.CSV", query_name="mine").collect()} == {"mine"}
    with pytest.raises(ValueError):
        lake.search(f"{folder}/header.csv")
    out = str(tmp_path / "ranking")
    export_ranking(lake.search_indexed("codes.CSV", top_n=None), out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_export_profiles(spark, folder, tmp_path):
    export_profiles(csv_source(spark, folder), str(tmp_path / "p"))
    for name in ("profiles", "profiles_normalized", "profiles_typed"):
        assert spark.read.parquet(str(tmp_path / "p" / name)).count() == 9


# (delimiter, quote, escape) as they are written; values hold delimiters, quotes and line breaks.
DIALECTS = {"comma.csv": (",", '"', ""), "semicolon.csv": (";", "'", ""), "tab.csv": ("\t", '"', ""), "pipe.csv": ("|", '"', "\\"), "semi.csv": (";", '"', "")}


def in_dialect(rows, delimiter, quote, escape):
    def field(v):
        if not any(c in v for c in (delimiter, quote, "\n")):
            return v
        return quote + (v.replace(escape, escape * 2).replace(quote, escape + quote) if escape else v.replace(quote, quote * 2)) + quote

    return "".join(delimiter.join(field(v) for v in r) + "\n" for r in rows).encode()


TALK = [("id", "price", "said")] + [
    (str(i), f"{i},5" if i % 3 else f"{i};7|8\t9", f"it's \"{i}\", he; said | twice\tor\nmore" if i % 4 else f"plain {i}") for i in range(80)]


@pytest.fixture(scope="module")
def dialects(tmp_path_factory):
    d = tmp_path_factory.mktemp("dialects")
    for name, parts in DIALECTS.items():
        (d / name).write_bytes(in_dialect(TALK, *parts))
    (d / "one.csv").write_text("only\n1;2\n3\n4;5\n")
    (d / "quoted head.csv").write_text("'a';'b'\n1;x\n2;y\n")
    (d / "ragged.csv").write_text("a,b;c\n1,2\n1,2;3\n1,2,3\n")
    (d / "apostrophes.csv").write_text("a,b\n'tis,1\n'twas,2\n")
    (d / "parts.csv").mkdir()
    (d / "parts.csv" / "part-0.csv").write_bytes(in_dialect(TALK[:40], ",", '"', ""))
    (d / "parts.csv" / "part-1.csv").write_bytes(in_dialect([TALK[0], *TALK[40:]], ";", "'", ""))
    return str(d)


@pytest.mark.parametrize("split", [None, 300])
def test_dialects(spark, dialects, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        source = csv_source(spark, dialects)
        cells = source.cells.groupBy("table_name", "row_id").agg(
            F.array_sort(F.collect_list(F.struct("column_pos", F.coalesce("v", F.lit(""))))).alias("r")).collect()
        names = rows(source.columns(), "table_name", "column_pos", "column_name")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    found = {}
    for r in cells:
        found.setdefault(r["table_name"], []).append(tuple(v for _, v in r["r"]))
    for name in [*DIALECTS, "parts.csv"]:
        assert sorted(found[name]) == sorted(TALK[1:]), name
        assert {(n, c) for t, n, c in names if t == name} == set(enumerate(TALK[0]))
    assert sorted(found["one.csv"]) == [("1;2",), ("3",), ("4;5",)]
    assert sorted(found["quoted head.csv"]) == [("1", "x"), ("2", "y")] and {c for t, _, c in names if t == "quoted head.csv"} == {"a", "b"}
    assert sorted(found["ragged.csv"]) == [("1", "2"), ("1", "2;3")]
    assert sorted(found["apostrophes.csv"]) == [("'tis", "1"), ("'twas", "2")]


def test_a_wide_table_of_each_dialect(spark, dialects):
    for name in [*DIALECTS, "parts.csv"]:
        assert sorted(tuple(r) for r in read_csv(spark, f"{dialects}/{name}", as_strings=True).collect()) == sorted(TALK[1:]), name


@pytest.mark.parametrize("dialect", [Dialect(b";", b"'"), Dialect(b"|", b'"', b"\\")])
@pytest.mark.parametrize("line", [b"a;b|c", b"'a;b", b'"a|b', b"'a'';b", b'"a\\"|b', b'"a\\\\"|b', b'x"|"', b"x';'", b"''", b'""', b'"\\"', b"'a'b;'"])
def test_state_after_a_line_of_a_dialect(dialect, line):
    import csv
    import io

    def is_open(text):
        kind = dict(delimiter=dialect.delimiter.decode(), quotechar=dialect.quote.decode(), escapechar=dialect.escape.decode() or None)
        return len(list(csv.reader(io.StringIO(text + "\nx\n"), doublequote=not dialect.escape, **kind))) != 2

    assert open_after(line, False, dialect) is is_open(line.decode())
    assert read_line(line, False, dialect).is_open is open_after(line, False, dialect)
    assert open_after(line, True, dialect) is is_open(dialect.quote.decode() + line.decode())
    assert read_line(line, True, dialect).is_open is open_after(line, True, dialect)


def test_texts_are_counted_once_before_they_are_typed(spark, tmp_path):
    """The counts are those of the typed cells, also where texts of one number differ and where a number is longer than a head."""
    rows = b"".join(b"%s,%d,x%d\n" % (b"0" * 300 + b"1.5" if i % 5 == 0 else b"01.50", i % 7, i % 3) for i in range(50))
    (tmp_path / "n.csv").write_bytes(b"real,whole,text\n" + rows + b"1.5,007,\n")
    source = csv_source(spark, str(tmp_path))
    assert source.counted is not None
    counts = sorted(map(tuple, source.raw_counts().join(source.columns(), "column_id").select("column_name", "v", "n").collect()), key=repr)
    cells = source.cells.join(source.columns().select("column_id", "column_name"), "column_id").groupBy("column_name", "v").count()
    assert counts == sorted(map(tuple, cells.collect()), key=repr)
    assert ("real", "1.5", 51) in counts and ("whole", "7", 1) in counts and ("text", None, 1) in counts


ODD = [
    "7", "+7", "-7", "007", "9" * 17, "9" * 18, "0" * 30, "1" + "0" * 18, "9223372036854775807", "9223372036854775808", "8" * 19, "-" + "1" * 20, "1" * 38,
    "1" * 39, "1.5", ".5", "5.", ".", "-.5e3", "1e5", "1E400", "1.2345678901234567", "1.23456789012345678", "0.12345678901234567", "0.012345678901234567", "-0.0",
    "123456789012345.67", "1234567890123456.78", "12345678901234567.", "2024-02-29", "2023-02-29", "2024-02-30", "2024-04-31", "2024-13-01", "0000-01-01", "0000-00-00",
    "2024-01-31 24:00:00", "2024-01-31 23:59:59", "2024-01-31T00:00:00.123456", "2024-01-31 00:00:00.1234567", "10:20:30", "1:02:03", "24:00:00", "1:2:3", "10:20:30.5",
    "true", "FALSE", "tRue", "truE ", "fal\u017fe", "area", "rust", "x", "1,5", "12\n", "12\r\n", "12\u0085", "2024-01-31\n", "1.5\u2028", " 7", "7 ", "\uff17", "-", "+", "e",
]


def test_texts_that_are_sure_of_their_types(spark):
    """What is told of a text without Spark's tests is what they say."""
    tested = spark.createDataFrame([(v,) for v in ODD], "v string").select("v", *[F.expr(test) for test in TYPE_TESTS.values()]).collect()
    for v, *outcome in tested:
        fits = csv_lake._Fits()
        fits.add(pa.array([None, v]))
        expected = sum(1 << i for i, passes in enumerate(outcome) if passes)
        assert fits.present and (fits.unsure == {v} and fits.fits & expected == expected or (fits.fits, fits.unsure) == (expected, set())), v


@pytest.fixture
def written(monkeypatch):
    """The labels of what the CSV reader writes."""
    labels = []
    write = csv_lake.materialize
    monkeypatch.setattr(csv_lake, "materialize", lambda df, label: labels.append(label) or write(df, label))
    return labels


def test_types_need_no_counts(spark, folder, written):
    """types are found while records are parsed; neither rows nor counts are written for them."""
    assert csv_source(spark, folder).columns().count() == 9
    assert set(written) <= {"csv_splits", "csv_types", "csv_fits"}


def test_a_profile_needs_no_table_of_rows(spark, folder, written):
    """counts are made of parsed records, and long texts are read where they lie."""
    prof = profile(csv_source(spark, folder))
    assert prof.column_profile.count() == 9
    assert set(written) <= {"csv_splits", "csv_types", "csv_fits"}


def test_counts_of_odd_texts_are_those_of_the_cells(spark, tmp_path):
    """Numbers are added up as numbers; negative zero, texts of one moment, times longer than a head and NULLs stay what they are."""
    time = "10:20:30." + "1" * 300
    lines = ["-0.0,7,2024-01-02 00:00:00,TRUE,90071992547409931234567,10:20:30,x", f"0.0,+7,2024-01-02T00:00:00.0,true,7,{time},", "-0,007,,false,,1:20:30,",
             f"1.50,,2024-01-02 00:00:01,False,07,{time}," + "y" * 300, ",-7,2024-01-02 00:00:00,TRUE,7,,Y"]
    (tmp_path / "odd.csv").write_text("\n".join(["real,whole,moment,flag,wide,time,text", *lines * 3]) + "\n")
    source = csv_source(spark, str(tmp_path))
    assert {r["column_name"]: r["data_type"] for r in source.columns().collect()} == {
        "real": "double", "whole": "bigint", "moment": "timestamp", "flag": "boolean", "wide": "decimal(38,0)", "time": "time", "text": "string"}
    plain = CellSource(source.cells, source.columns())
    columns = ["column_id", "type_class", "v", "long", "i", "d", "n"]
    assert sorted(map(tuple, source.raw_counts().select(columns).collect()), key=repr) == sorted(map(tuple, plain.raw_counts().select(columns).collect()), key=repr)
    ids = {r["column_id"] for r in source.columns().collect()}
    for cleaned in (True, False):
        assert sorted(source.long_texts(cleaned, ids).collect()) == sorted(plain.long_texts(cleaned, ids).collect())


def test_a_wide_table_is_written_by_its_types(spark, tmp_path, written):
    """files of one folder share a table's types, and the typed columns are written once, no rows of texts."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("n,d,s\n1,2024-01-02,\n2,2024-01-03,7\n")
    (tmp_path / "t" / "b.csv").write_text("n,d,s\n1.5,2024-01-04,x\n,,\n")
    df = read_csv(spark, str(tmp_path / "t"))
    assert dict(df.dtypes) == {"n": "double", "d": "date", "s": "string"}
    assert sorted((r["n"] or 0, str(r["d"]), r["s"]) for r in df.collect()) == [
        (0, "None", None), (1.0, "2024-01-02", None), (1.5, "2024-01-04", "x"), (2.0, "2024-01-03", "7")]
    assert set(written) <= {"csv_splits", "csv_types", "csv_fits", "csv_table"}
