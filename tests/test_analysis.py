"""Analysers: driver and column rules agree, and follow the stemming and splitting tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumidex.functions import analysis as A

EN = [
    ("glasses", "glass"), ("gas", "ga"), ("puppies", "puppi"), ("ties", "ti"), ("hopping", "hop"), ("falling", "fall"), ("buzzing", "buzz"), ("seeing", "se"), ("string", "string"), ("bring", "bring"),
    ("wanted", "want"), ("red", "red"), ("bled", "bled"), ("slowly", "slow"), ("fly", "fly"), ("boxes", "box"), ("boss", "boss"), ("is", "is"), ("dogs", "dog"), ("DOGS", "dog"), ("Ärger", "ärger"), ("más", "má"), ("a11ed", "a1"),
]
ES = [("rápidamente", "rapida"), ("mente", "mente"), ("flores", "flor"), ("casas", "casa"), ("más", "ma"), ("es", "es"), ("Niños", "niño"), ("pingüino", "pinguino"), ("ÁÉ", "ae")]
SPLIT = [
    ("a-b c", ["a", "b", "c"]), ("1,000.50 at 12:30", ["1,000.50", "at", "12:30"]), ("2024-01-31.", ["2024-01-31"]), ("v1.2x", ["v1.2x"]), ("1..2", ["1", "2"]), ("x.1", ["x", "1"]), ("ñandú's", ["ñandú", "s"]), ("-5", ["5"]), ("1-a", ["1", "a"]), ("", []), ("中文 ٣٫٤ ٣.٤", ["中文", "٣", "٤", "٣.٤"]),
]


def columns(spark, analyzer, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(A.ANALYZERS[analyzer].column(F.col("t"))).collect()]


@pytest.mark.parametrize("analyzer,table", [("en", EN), ("es", ES)])
def test_stems(spark, analyzer, table):
    assert [A.ANALYZERS[analyzer].local(w) for w, _ in table] == [[s] for _, s in table]
    assert columns(spark, analyzer, [w for w, _ in table]) == [[s] for _, s in table]
    df = spark.createDataFrame(table, "w string, s string")
    assert df.where(F.expr(A.stem_sql("w", analyzer)) != F.col("s")).count() == 0


def test_words(spark):
    assert [A.split_words(t) for t, _ in SPLIT] == [w for _, w in SPLIT]
    df = spark.createDataFrame([(t,) for t, _ in SPLIT], "t string")
    assert [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(A.WORD), F.lit(0))).collect()] == [w for _, w in SPLIT]


@given(st.lists(st.text(st.sampled_from("aeisngdlymtzé ñ1.2,:-/SU"), max_size=25), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_driver_and_columns_agree(spark, texts):
    for name in ("en", "en_stop", "es", "es_stop"):
        assert columns(spark, name, texts) == [A.ANALYZERS[name].local(t) for t in texts]


def test_stop_words_go_after_stemming():
    assert A.ANALYZERS["en_stop"].local("This was during the having of dogs") == ["dog"]
    assert A.ANALYZERS["es_stop"].local("Según los gatos así") == ["gato"]


def test_typed_values(spark):
    ints = ["12", "-7", "+3", " 12 ", "1e3", "12.7", "", "9223372036854775807", "9223372036854775808", "x"]
    assert columns(spark, "int", ints) == [v[0] if (v := A.ANALYZERS["int"].local(s)) else None for s in ints] == [12, -7, 3, None, None, None, None, 2**63 - 1, None, None]
    floats = ["1.5", "-2", ".5", "3.", "1e3", "1d", "", "nan", " 1"]
    assert columns(spark, "float", floats) == [v[0] if (v := A.ANALYZERS["float"].local(s)) else None for s in floats] == [1.5, -2.0, 0.5, 3.0, 1000.0, None, None, None, None]
    dates = ["1970-01-02", "2020-02-30", "2020-1-5", "1969-12-31", "2020-02-29x"]
    assert columns(spark, "date", dates) == [v[0] if (v := A.ANALYZERS["date"].local(s)) else None for s in dates] == [86_400 * 10**9, None, None, -86_400 * 10**9, None]
    assert A.ANALYZERS["keyword"].local("") == [""]
