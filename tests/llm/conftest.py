import pytest

AWKWARD = [
    (1, "plain words and more of them " * 20, "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "a text whose id is null, with a few words and token = 0123456789abcdef0123", "en"),
    (4, "plain words and more of them " * 20, "fr"),
    (4, "plain words and more of them " * 20, "fr"),
    (5, " \n\t ", ""),
    (6, "x" * 50_000, "xx"),
    (7, "lorem ipsum dolor sit amet " * 4_000, "la"),
]
# extra columns whose names the operators use themselves
CLASHING = (
    "doc_id bigint, text string, lang string, _id string, _text string, key string, words string, seed string, "
    "host string, rule string, leak string, own_key string, low string, bands string, n_chars bigint, source string"
)


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame([(*row, *["clash"] * 11, 9, "s") for row in AWKWARD], CLASHING)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], CLASHING)
