import pytest

#: Whole texts that operators must not stumble over.
ODD = [None, "", " ", "  a  b ", "x\n\ny", "The MIT License", "same text here again", "same text here again", "é́ ﬁ İ Σς", "<|endoftext|> a <|startoftext|>", "word " * 3000, "a" * 9000, "日本語 テスト", "\x1c \x85  ", "Mail: a.b@c.example.org or +1 (017) 555-7713."]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under ascending ids, a null id, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "x", -1) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None), (3, "  a  b ", "en", "s0", 7, "x", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, part int").repartition(3)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
