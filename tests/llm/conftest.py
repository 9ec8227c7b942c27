import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from texts; extra columns have names that operators use."""

    def make(texts, ids=None, **extra):
        ids = list(range(len(texts))) if ids is None else ids
        columns = {"size": "word", "score": 1.5, "kept": True, "comp": 3, **extra}
        rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), *columns.values()) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        kinds = {str: "string", float: "double", bool: "boolean", int: "int"}
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items())
        return spark.createDataFrame(rows, schema)

    return make


ODD = [None, "", " \n\t ", "x", "same words here again", "same words here again", "é▁ 日本 \x00", "word " * 3000, "a\n\nb\r\n c\x0b\x0cd"]


@pytest.fixture()
def odd():
    return list(ODD)
