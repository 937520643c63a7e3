import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewatch.operators.load import convert_sas_dates, load_report, tidy_blanks
from sitewatch.plans import jobs
from sitewatch.session import saved
from sitewatch.sources import xport
from sitewatch.sources.schema import DOMAIN_NAMES, NUMBER_COLUMNS, TEXT_COLUMNS
from sitewatch.sources.tables import read_domains
from tests.transport import Column, write_transport


def read(spark, path, **options):
    xport.register(spark)
    return spark.read.format("sas_transport").options(**options).load(path)


def sample(n, text_width=13, number_width=8):
    numbers = [None if i % 7 == 0 else (i - n / 2) * 1.5 for i in range(n)]
    texts = ["" if i % 5 == 0 else f"  r\xe9sum\xe9 {i} " for i in range(n)]
    return [
        Column("USUBJID", 9, True, [f"S{i:06d}" for i in range(n)]),
        Column("TXT", text_width, True, texts),
        Column("NUM", number_width, False, numbers),
    ]


def stripped(values):
    return [v.strip() for v in values]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 80, 1001])
def test_reads_what_was_written(spark, tmp_path, n):
    columns = sample(n)
    path = write_transport(tmp_path / "a.xpt", columns)
    got = read(spark, path, rangeBytes=500).orderBy("USUBJID").collect()
    assert [r["USUBJID"].strip() for r in got] == columns[0].values
    cut = [t.ljust(13)[:13] for t in columns[1].values]
    assert stripped(r["TXT"] for r in got) == stripped(cut)
    assert [r["NUM"] for r in got] == columns[2].values


def test_same_as_pandas_reader(spark, tmp_path):
    # Long rows only: on short ones pandas takes blank text for padding.
    path = write_transport(tmp_path / "a.xpt", sample(203, text_width=90))
    got = read(spark, path, rangeBytes=2000).orderBy("USUBJID").toPandas()
    want = pd.read_sas(path, format="xport", encoding="latin1")
    assert stripped(got["USUBJID"]) == stripped(want["USUBJID"])
    assert stripped(got["TXT"]) == stripped(want["TXT"])
    np.testing.assert_array_equal(got["NUM"].to_numpy(float), want["NUM"].to_numpy(float))


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    path = write_transport(tmp_path / "a.xpt", sample(1001))
    df = read(spark, path, rangeBytes=3000)
    assert df.select(F.spark_partition_id()).distinct().count() == 11
    assert df.select(F.count_distinct("USUBJID")).first()[0] == 1001


@pytest.mark.parametrize("width", [3, 4, 5, 6, 7, 8])
def test_short_numbers_and_special_missing(spark, tmp_path, width):
    values = [0.0, 1.0, -1.0, 0.5, 118.0, -4096.0, 1 / 16, None, "_", "A", "Z", "."]
    cols = [
        Column("USUBJID", 3, True, [f"{i:03d}" for i in range(len(values))]),
        Column("NUM", width, False, values),
    ]
    path = write_transport(tmp_path / "a.xpt", cols)
    got = [r["NUM"] for r in read(spark, path).orderBy("USUBJID").collect()]
    assert got == [v if isinstance(v, float) else None for v in values]


def test_missing_is_null_not_nan(spark, tmp_path):
    path = write_transport(tmp_path / "a.xpt", sample(50))
    assert read(spark, path).filter(F.isnan("NUM")).count() == 0
    assert read(spark, path).filter("NUM IS NULL").count() == 8


def test_folder_of_files_and_column_union(spark, tmp_path):
    write_transport(tmp_path / "a.xpt", sample(30))
    extra = [
        Column("USUBJID", 9, True, ["T1", "T2"]),
        Column("NEW", 8, False, [1.0, None]),
    ]
    write_transport(tmp_path / "b.xpt", extra)
    df = read(spark, str(tmp_path))
    assert df.columns == ["USUBJID", "TXT", "NUM", "NEW"]
    assert df.count() == 32
    assert df.filter("NEW = 1").first()["TXT"] is None


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.xpt").write_bytes(b"not a transport file".ljust(800))
    with pytest.raises(Exception, match="not a version 5 transport file"):
        read(spark, str(tmp_path / "a.xpt")).count()


def test_two_stages_equal_the_plain_source(spark, tmp_path):
    write_transport(tmp_path / "a.xpt", sample(1001))
    write_transport(tmp_path / "b.XPT", sample(0))
    (tmp_path / "below").mkdir()
    write_transport(tmp_path / "below" / "c.xpt", [Column("USUBJID", 9, True, ["T1", "T2"]), Column("NEW", 8, False, [1.0, None])])
    (tmp_path / "notes.txt").write_text("not a study")
    want = read(spark, str(tmp_path), rangeBytes=3000)
    got = xport.read_transport(spark, str(tmp_path), range_bytes=3000)
    assert got.schema == want.schema
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert xport.read_transport(spark, f"file://{tmp_path}/a.xpt").count() == 1001


def test_many_small_files_take_few_tasks_and_one_look_at_each_header(spark, tmp_path):
    for i in range(2000):
        write_transport(tmp_path / f"{i:04d}.xpt", [Column("USUBJID", 6, True, [f"S{i:04d}"] * (i % 3 + 1))])
    headers = xport.read_headers(spark, str(tmp_path))
    assert headers.rdd.getNumPartitions() < 100
    headers = saved(headers)
    assert headers.count() == 2000
    for path in tmp_path.glob("*.xpt"):
        data = path.read_bytes()
        at = data.index(b"OBS     HEADER RECORD") + 60
        path.write_bytes(b"?" * at + data[at:])
    got = xport.read_ranges(xport.packed_ranges(headers), xport.column_union(headers))
    assert got.rdd.getNumPartitions() < 100
    counts = {r["USUBJID"].strip(): r["count"] for r in got.groupBy("USUBJID").count().collect()}
    assert counts == {f"S{i:04d}": i % 3 + 1 for i in range(2000)}


def test_columns_of_two_types_are_refused(spark, tmp_path):
    write_transport(tmp_path / "a.xpt", [Column("X", 8, False, [1.0])])
    write_transport(tmp_path / "b.xpt", [Column("X", 8, True, ["1"])])
    with pytest.raises(ValueError, match="b.xpt: X has another type"):
        xport.read_transport(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no transport files"):
        xport.read_transport(spark, str(tmp_path / "none"))


def test_text_is_decoded_as_latin1():
    raw = np.array([[65, 233, 32], [0, 0, 0], [255, 128, 127], [66, 0, 0]], dtype=np.uint8)
    want = [bytes(r).rstrip(b"\0").decode("latin1") for r in raw]
    assert xport.decode_text(raw).to_pylist() == want
    assert xport.decode_text(np.full((2, 3), 65, np.uint8)).to_pylist() == ["AAA", "AAA"]
    assert xport.decode_text(np.zeros((0, 4), np.uint8)).to_pylist() == []


def test_file_uri(spark, tmp_path):
    path = write_transport(tmp_path / "a.xpt", sample(10))
    assert read(spark, f"file://{path}").count() == 10
    assert read(spark, f"file://{tmp_path}").count() == 10


def test_tidy_blanks(spark):
    rows = [(" a b ",), ("",), ("   ",), ("\t\n x\xa0",), (None,), ("\x1f ",)]
    got = [r[0] for r in tidy_blanks(spark.createDataFrame(rows, "t string")).collect()]
    assert got == ["a b", None, None, "x", None, None]
    assert got == [(r[0].strip() or None) if r[0] is not None else None for r in rows]


def test_sas_dates(spark):
    rows = [(0.0, 1.0), (-1.0, 2.0), (19723.0, 3.0), (None, 4.0), (float("nan"), 5.0), (1.75, 6.0)]
    df = convert_sas_dates(spark.createDataFrame(rows, "TRTSDT double, AGE double"),
                           ("TRTSDT", "RFENDT"))
    assert [r["TRTSDT"] for r in df.orderBy("AGE").collect()] == [
        "1960-01-01", "1959-12-31", "2013-12-31", None, None, "1960-01-02"
    ]
    assert df.columns == ["TRTSDT", "AGE"]


def raw_study(folder, n=40):
    """Transport files of all six domains, with untidy text and SAS dates."""
    for name in DOMAIN_NAMES:
        columns = [
            Column(c, 12, True, [f" {c[:4]}{i} " if i % 6 else "" for i in range(n)])
            for c in TEXT_COLUMNS[name]
        ]
        columns[0] = Column("USUBJID", 12, True, [f"S{i}" for i in range(n)])
        columns += [
            Column(c, 8, False, [float(i) if i % 4 else None for i in range(n)])
            for c in NUMBER_COLUMNS[name]
        ]
        if name == "adsl":
            columns.append(Column("TRTSDT", 8, False, [19000.0 + i for i in range(n)]))
        write_transport(folder / f"{name}.xpt", columns)


def test_load_job(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    raw_study(raw)
    report = {r["domain"]: r for r in jobs.run_load(str(raw), str(tmp_path / "data")).collect()}
    assert set(report) == set(DOMAIN_NAMES)
    assert all(r["n_rows"] == 40 and r["n_subjects"] == 40 for r in report.values())
    assert report["adsl"]["n_columns"] == 13
    loaded = read_domains(spark, str(tmp_path / "data"))
    assert loaded["ae"].filter("AEENDTC = ''").count() == 0
    assert loaded["ae"].filter("AEENDTC IS NULL").count() == 7
    assert loaded["adsl"].orderBy("TRTSDT").first()["TRTSDT"] == "2012-01-08"
    # Loading again replaces the tables.
    jobs.run_load(str(raw), str(tmp_path / "data"))
    assert read_domains(spark, str(tmp_path / "data"))["dm"].count() == 40


def test_missing_column_is_named(spark, tmp_path):
    spark.range(3).selectExpr("string(id) AS USUBJID").write.parquet(f"{tmp_path}/dm")
    with pytest.raises(ValueError, match="SITEID string"):
        read_domains(spark, str(tmp_path))


def test_report_counts_missing_and_repeated_subjects(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "USUBJID string")
    row = load_report({"ex": df}).first()
    assert (row["n_rows"], row["n_subjects"], row["n_without_subject"]) == (3, 1, 1)
