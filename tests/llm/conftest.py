import pytest

#: Rows that every operator on documents must handle: null, empty, white space only, very long,
#: repeated texts and repeated rows, control strings, many scripts.
LONG = "The quick brown fox jumps over the lazy dog, and 12345 more. " * 4000
TEXTS = {
    0: "The cat sat on the mat and looked at the dog for a while.",
    1: None,
    2: "",
    3: " \t\n ",
    4: LONG,
    5: "The cat sat on the mat and looked at the dog for a while.",
    6: "the CAT sat on the mat and looked at the dog for a while.",
    7: "<|endoftext|> and </s>[INST] it's they'll 3.14 İ ß 漢字 😀 ՘x\x1c y\x85z",
    8: "12345 678 !!! ---",
    9: "x" * 3000,
    10: "Der Hund und die Katze gehen in den Garten, weil es nicht regnet.",
    11: "Le chat et le chien sont dans la maison avec les enfants.",
}


def rows(texts=TEXTS):
    lang = {10: "de", 11: "fr", 1: None, 8: None}
    return [(i, t, lang.get(i, "en"), "src", -1, "mine") for i, t in texts.items()]


SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long, kept string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases with columns whose names clash with results, and one row repeated."""
    own = rows()
    return spark.createDataFrame([*own, own[0]], SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
