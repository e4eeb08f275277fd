"""Letters whose case mapping is not one to one, and headings that begin with none, against the SQL."""

import duckdb
import pytest
from test_queries import rows

from tessera.plans.every import QUERIES, SQL


@pytest.mark.parametrize("name", ["a15_page_folders", "a17_page_bundles"])
def test_folders_are_one_character(spark, tmp_path, name):
    titles = ["ßa", "sa", "Sb", "ﬁx", "ŉ", "ᾳ", "ᾀx", "ᾈ", "ẞ", "éa", "", "1", "11", "aa"]
    pages = [(i, f"<title>{t}</title>") for i, t in enumerate(titles)] + [(111, "<title></title>")]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_headings_that_begin_without_letters(spark, tmp_path):
    heads = ["- Foo", " bar", "Foo", "ΟΔΟΣ Α", "ΟΔΟΣΑ", "ΟΔΟΣ", "--", "Bar Two", "İx y", "bart"]
    docs = [(i, "en", "s", h + "\nx\n") for i, h in enumerate(heads)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "f14_canonical_names"
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_only_the_least_canonical_form_of_an_alias_begins_names(spark, tmp_path):
    heads = [" bar", "bar ", "bart", "fo obar", "foob ar", "foo bar", "foobarn", "foobert", "x  ", "\u3000x y", "ﬀ x"]
    docs = [(i, "en", "s", h + "\nx\n") for i, h in enumerate(heads)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "f14_canonical_names"
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(SQL[name]).df())


def same(spark, tmp_path, name, texts):
    docs = [(i, "en", "s", t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["t13_rejected_responses", "c2_gated_responses"])
def test_a_blank_claim_is_dropped_and_its_response_read(spark, tmp_path, name):
    same(spark, tmp_path, name, [x for t in ("plain\nx", "", " ", "\nsecond", "\t\nx", "  \nx", "　", None, '"[{') for x in [t] * 10])


@pytest.mark.parametrize("name", ["tc1_topic_clusters", "t2_heading_chunks"])
def test_topics_of_figures_sizes_and_spaces(spark, tmp_path, name):
    heads = ["12345", "12 cm", "欧码12", " 尺码XL", "ab", "\u00a0ab", "abc\u00a0", "\u3000ab\u3000", "x" * 30 + "、" + "y" * 30, "x" * 20 + "、" + " " * 40, "ABC", "abc", ""]
    same(spark, tmp_path, name, [f"{h}\nb\nc\nd\ne\n{h}\nLicensed under x" for h in heads for _ in range(2)] + heads)


@pytest.mark.parametrize("name", ["s1_scanned_files", "s3_normalised_texts"])
def test_texts_of_spaces_and_odd_ends(spark, tmp_path, name):
    same(spark, tmp_path, name, ["\u00a0", " \u3000\n", "a \u2028", "a\t\u0085", "a\n\u2029", "\u2028 ", "\t", "", None, "a\r\n\r\n\r\n\r\nb \n", "x"])
