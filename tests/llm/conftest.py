"""Small tables that hold every awkward case at once."""

import random

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "é", "Ünder", "a#b", "<x>", "\\y"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents():
    """Exact and near copies, shared passages, one very long text, empty, null and blank texts, tied and repeated rows."""
    rng = random.Random(3)
    passage, line = prose(rng, 40), prose(rng, 15)
    texts = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 90))
        if i % 5 == 0:
            text = f"{text} {passage} {prose(rng, 4)}"
        if i % 4 == 1:
            text = f"{prose(rng, 3)}\n{line}\n{text}"
        if i % 11 == 3:
            text = texts[i // 2]
        if i % 13 == 5 and texts[i // 2]:
            words = texts[i // 2].split(" ")
            words[len(words) // 2] = "edited"
            text = " ".join(words)
        texts.append(text)
    texts += ["", None, " \t\n", "one", "the " * 300, "the " * 40, "ab" * 200, "ab" * 90, prose(rng, 6000)]
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, odd_documents):
    return spark.createDataFrame(odd_documents, DOCUMENTS).repartition(5).cache()


@pytest.fixture(scope="session")
def awkward(spark, odd_documents):
    """The same rows with a repeated row, a row without an id, nulls everywhere, and columns that clash with the operators'."""
    rows = [*odd_documents, odd_documents[7], (None, "no id at all " * 9, None, None, None), (None, None, None, None, None)]
    extra = ("fp string, component_id string, spans string, rest string, kept string, score string, tokens string, "
             "text_key string, fingerprint string, epoch string, block string, x string, label string, _doc string")
    values = tuple("z" for _ in extra.split(", "))
    return spark.createDataFrame([r + values for r in rows], f"{DOCUMENTS}, {extra}").repartition(3).cache()


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
