import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def table(spark):
    """A documents-like table with extra columns whose names also occur inside the operators."""
    def make(texts, first=0, ids=None):
        rows = [(None if t is Ellipsis else (first + i if ids is None else ids[i]), None if t is Ellipsis else t, "x", "y", 1, "z", "w") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, key string")
    return make
