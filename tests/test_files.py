"""CSV, Parquet and JSON, file metadata and generated row keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import Rule, validate
from plumbline.sources import files, row_keys, storage


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("separator", [",", "\t", ";", "|"])
def test_separators(spark, tmp_path, separator):
    path = write(tmp_path / "a.csv", "\n".join(separator.join(r) for r in [("id", "name"), ("1", "x"), ("2", "y")]))
    assert [tuple(r) for r in files.read_csv(spark, path).orderBy("id").collect()] == [(1, "x"), (2, "y")]


def test_encodings(spark, tmp_path):
    latin = write(tmp_path / "latin.csv", "id,name\n1,caf\xe9\n", "latin-1")
    assert files.detect_csv(spark, latin).encoding == "ISO-8859-1"
    assert files.read_csv(spark, latin).first()["name"] == "café"
    utf8 = write(tmp_path / "utf8.csv", "id,name\n1,café\n")
    assert files.detect_csv(spark, utf8).encoding == "UTF-8"
    assert files.read_csv(spark, utf8).first()["name"] == "café"


def test_every_file_in_its_own_encoding(spark, tmp_path):
    """A Latin-1 file leaves the UTF-8 files of its folder as they are."""
    write(tmp_path / "a.csv", "id,name\n1,Zo\xeb\n")
    write(tmp_path / "b.csv", "id,name\n2,Zo\xeb\n", "latin-1")
    write(tmp_path / "c.csv", "name,id\n\u20ac\u201cx\u201d,3\n", "cp1252")
    write(tmp_path / "d.csv", "\ufeffid,name\n4,\u65e5\n")
    write(tmp_path / "e.csv", 'id,name\n5,"two\nlines \xe9"\n', "latin-1")
    (tmp_path / "f.csv").write_bytes(b"id,name\n6,\x81\xe9\n")
    rows = {r.id: r.name for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {1: "Zoë", 2: "Zoë", 3: "€“x”", 4: "日", 5: "two\nlines é", 6: "\x81é"}
    formats = {r.file_name: (r.encoding, r.multiline, r.lines) for r in files.file_formats(spark, str(tmp_path)).collect()}
    assert formats == {
        "a.csv": ("UTF-8", False, 2), "b.csv": ("ISO-8859-1", False, 2), "c.csv": ("windows-1252", False, 2), "d.csv": ("UTF-8", False, 2),
        "e.csv": ("ISO-8859-1", True, 3), "f.csv": ("ISO-8859-1", False, 2),
    }
    assert files.detect_csv(spark, str(tmp_path), encoding="UTF-8", multiline=False).groups == ()


def test_files_with_different_columns(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name\n1,Zo\xeb\n")
    write(tmp_path / "b.csv", "id,other\n2,Zo\xeb\n", "latin-1")
    with pytest.raises(ValueError, match="different columns"):
        files.read_csv(spark, str(tmp_path))


def test_malformed_rows_are_violations(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,n\n1,x,5\n2,y\n3,z,6,7\n4,"a,b",8\nNA,N/A,9\n')
    df = files.read_csv(spark, path, malformed_column="bad")
    assert df.columns == ["id", "name", "n", "bad"]
    assert {r.id: (r.name, r.n, r.bad) for r in df.collect()} == {1: ("x", 5, None), 2: ("y", None, "2,y"), 3: ("z", 6, "3,z,6,7"), 4: ("a,b", 8, None), None: (None, 9, None)}
    run = validate(df, [Rule("M", "bad", "business_rule", params={"expression": "bad IS NULL"})], key=["id"])
    assert sorted(r.row_key.id for r in run.violations.collect()) == [2, 3]
    assert run.rule_results.first().failed_count == 2


def test_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", "i,f,b,t,e,m\n1,1.5,True,x,,1\nNA,2,false,N/A,,a\n3,null,TRUE,None,nan,2\n")
    df = files.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x", None, "1"), (None, 2.0, False, None, None, "a"), (3, None, True, None, None, "2")]
    given = T.StructType.fromDDL("i STRING, f STRING, b STRING, t STRING, e STRING, m INT")
    assert files.read_csv(spark, path, schema=given).first()["m"] == 1
    assert files.read_csv(spark, path, null_tokens=[]).first()["e"] is None


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'id,text\n1,"two\nlines"\n2,"a ""quote"""\n3,"x,y"\n')
    assert files.detect_csv(spark, path).multiline is True
    assert [r["text"] for r in files.read_csv(spark, path).orderBy("id").collect()] == ["two\nlines", 'a "quote"', "x,y"]
    flat = write(tmp_path / "f.csv", 'id,text\n1,"a ""quote"""\n')
    assert files.detect_csv(spark, flat).multiline is False
    assert files.read_csv(spark, flat).first()["text"] == 'a "quote"'


def test_bad_csv(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        files.read_csv(spark, write(tmp_path / "e.csv", ""))
    one = write(tmp_path / "one.csv", "id\n1\n")
    with pytest.raises(ValueError, match="separator"):
        files.read_csv(spark, one)
    assert files.read_csv(spark, one, separator=",").first()["id"] == 1


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b", c ', 2.5), (2, "line\nbreak", None)], "i BIGINT, t STRING, x DOUBLE")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == sorted(tuple(r) for r in df.collect())


def test_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 3
    spark.range(0).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no rows"):
        files.read_parquet(spark, str(tmp_path / "none"))
    write(tmp_path / "text.parquet", "not parquet at all")
    with pytest.raises(Exception):
        files.read_parquet(spark, str(tmp_path / "text.parquet")).collect()


def test_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "i BIGINT, t STRING")
    row = files.dataset_metadata(df).first()
    assert (row["rows"], row["columns"], row["null_count"], row["duplicated_rows"]) == (3, 2, 1, 1)
    assert row["null_per_column"] == {"i": 1, "t": 0} and row["dtypes"] == ["bigint", "string"]
    path = write(tmp_path / "a.csv", "id,name\n1,x\n")
    assert files.file_metadata(spark, path).first().asDict() == {"file_name": "a.csv", "file_size_bytes": 12}


def test_preview(spark):
    df = spark.range(100).repartition(5)
    assert [r["id"] for r in files.preview(df, ["id"], 3).collect()] == [0, 1, 2]
    assert files.safe_sample(df.limit(2), ["id"]).count() == 2


def test_report(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, None)], "a INT, b STRING"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()["value"] == '{"a":1,"b":null}'


def test_generated_keys(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "c STRING").coalesce(1).write.parquet(str(tmp_path / "p"))
    for source in (spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([("a",), ("b",), ("a",)], "c STRING").coalesce(1)):
        keyed = row_keys.with_row_key(source)
        rules = [Rule("R1", "c", "unique"), Rule("R2", "_all", "duplicate_row")]
        run = validate(keyed, rules, key=["row_file", "row_index"])
        assert [r["row_key"]["row_index"] for r in run.violations.collect()] == [2, 2]


def test_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_dir(spark) == configured
    assert storage.scratch_path(spark, "x").startswith(configured + "/x-")
    df = storage.cut_lineage(spark.range(3).withColumn("x", F.col("id") * 2))
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().toString()
