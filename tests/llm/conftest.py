import pytest

SF = "/root/testdata/sf0.001"
VOCABULARIES = "/opt/tokenizers"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows that every operator must bear: null, empty and blank texts, a repeated row, a null id, control and non-ASCII characters, and columns with the names of results."""
    rows = [
        (1, "This work is licensed under CC BY 4.0. All rights reserved."), (2, None), (3, ""), (4, " \n\t \x0b"), (5, "same text here"), (5, "same text here"), (None, "a text without an id"),
        (6, "Ünïcode — «text» 中文 한국어 😀 é \x1c\x85\xa0 end"), (7, "word " * 4000), (8, "x" * 20000), (9, "<|endoftext|> <|startoftext|>It's 12 o'clock"), (10, "a  b\n\nc \n d  "),
    ]
    return spark.createDataFrame([(i, t, "kept", -1.0) for i, t in rows], "doc_id long, text string, labels string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score double")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
