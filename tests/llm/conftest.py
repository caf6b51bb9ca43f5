import pytest

from cohortspark.llm import queries  # noqa: F401  the operators must import
from cohortspark.llm.common import table

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns of a table that share names with what the operators use inside.
CLASHES = "key string, bits string, node string, k string, t string, d string, ids string, place string, host string, spans string, _lang_pred string"
CLASHES += ", _lang_score string, _masked string, _d string, _k string, _kept_d string, _kept_k string, _of string, _start string"
CLASHES += ", _end string, _kept string, _t string, __k string"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A documents table from texts or (id, text) pairs."""

    def build(*texts, extra=False):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
        if extra:
            for column in CLASHES.split(", "):
                frame = frame.selectExpr("*", f"'x' AS {column.split()[0]}")
        return frame

    return build


@pytest.fixture
def odd_texts():
    """Null, empty, blanks, one word, no blank for long, very long, repeated rows, other scripts."""
    long_line = "the quick brown fox jumps over the lazy dog " * 3000
    return [
        None, "", "   \n\t ", "word", "a" * 5000, long_line, "twice the same text here", "twice the same text here",
        "\u00e9\u00e8 \u4f60\u597d \U0001f600\U0001f600 \u0440\u0443\u0441", "1 2 3 4\n\n\n5", "###$$$ %%%", None, "",
    ]


@pytest.fixture
def documents(spark, small):
    return table(spark, small, "documents")
