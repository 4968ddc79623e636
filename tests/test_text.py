import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import codec, text


@pytest.mark.parametrize("variant", ["Liisa KÄRKI", "KÄRKI Liisa", "kärki, liisa", "Liisa K&#xC4;RKI", "Liisa K&Auml;RKI", unicodedata.normalize("NFD", "Liisa KÄRKI"), "Liisa KA¨RKI", "Liisa Kärki", "Liisa  \n Karki"])
def test_variants_share_key_and_match(variant):
    assert text.key_of(variant) == text.key_of("Liisa Kärki")
    assert text.compiled(text.pattern_of("Liisa Kärki")).search(text.fold("(" + variant + ")."))


@pytest.mark.parametrize("other", ["Liisa Kärkinen", "Liisa", "XLiisa Kärki", "Liisa-Kärki"])
def test_other_names_do_not_match(other):
    assert not text.compiled(text.pattern_of("Liisa Kärki")).search(text.fold(other))


def test_long_names_are_searched_both_ways_only():
    name = "a1 b2 c3 d4 e5"
    find = text.compiled(text.pattern_of(name)).search
    assert find(name) and find("e5 d4 c3 b2 a1") and not find("b2 c3 d4 e5 a1")
    assert text.key_of("b2 c3 d4 e5 a1") == text.key_of(name)


def test_letters_that_stay():
    assert text.fold("Straße Øł ´") == "strasse øł"
    with pytest.raises(ValueError):
        text.pattern_of(" , ")


@given(st.text(max_size=30))
def test_fold_is_stable_and_ignores_form(t):
    once = text.fold(t, unescape=False)
    assert text.fold(unicodedata.normalize("NFD", t), unescape=False) == text.fold(unicodedata.normalize("NFC", t), unescape=False)
    assert "  " not in once


def test_glyphs_keep_their_places():
    assert text.fold_glyphs(["ß", " ", "Ä", "́"]) == ("ss a", [0, 0, 1, 2])


def test_columns_agree_with_python(spark):
    names = ["Aino  MÄKI", "mäki, aino", None, "", "ß ß"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("f", text.fold_text(F.col("n"))).withColumn("k", text.name_key(F.col("f")))
    rows = df.collect()
    assert [r.f for r in rows] == [None if n is None else text.fold(n) for n in names]
    assert [tuple(r.k) if r.k is not None else None for r in rows] == [None if n is None else text.key_of(n) for n in names]


@pytest.mark.parametrize("data", ["plain", "ä".encode(), "ä".encode("cp1252"), bytes(range(256)), b"<meta charset=utf-16>\xff", "<meta charset='iso-8859-15'>€".encode("iso-8859-15")])
def test_decoding_gives_the_bytes_back(data):
    data = data.encode() if isinstance(data, str) else data
    text_, used = codec.decode(data)
    assert text_.encode(used) == data


def test_replacements_are_spelled_like_the_page():
    assert codec.spelled("pyynnöstä", b"<p>x</p>", "utf-8") == "pyynn&#xF6;st&#xE4;"
    assert codec.spelled("ö€", "ä".encode("latin-1"), "latin-1") == "ö&#8364;"
    assert codec.spelled("ö", "ä".encode(), "utf-8") == "ö"


def test_entities_column(spark):
    assert spark.createDataFrame([("aä€😀",), ("",)], "t string").select(codec.entities(F.col("t"))).collect()[0][0] == "a&#xE4;&#x20AC;&#x1F600;"
