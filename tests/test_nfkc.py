"""Normal forms of whole texts by their distinct words."""

import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import text

letters = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ̧́´ ﷺلآ각e "))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(letters, max_size=12)), max_size=8))
def test_words_make_the_text(rows):
    got = text._normal(pa.array(rows, pa.string())).to_pylist()
    assert got == [None if x is None else unicodedata.normalize("NFKC", x) for x in rows]


def test_slices_of_batches():
    column = pa.array(["x", None, "ẛ̣ a", "", " ", "ﬁn  ﬁn"])
    for lo in range(6):
        assert text._normal(column.slice(lo)).to_pylist() == [None if x is None else unicodedata.normalize("NFKC", x) for x in column.to_pylist()[lo:]]


def test_column(spark):
    rows = [("plain",), (None,), ("ﬁn ①②",), ("",), ("é " * 5000,)]
    df = spark.createDataFrame(rows, "t string").withColumn("n", F.lit(1))
    got = [r.t for r in text.nfkc(df, "t").collect()]
    assert got == [None if x is None else unicodedata.normalize("NFKC", x) for (x,) in rows]
