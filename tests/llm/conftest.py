import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, t string, r int, k string, x double, size int, rank int, spans string, copies int"


def _row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), 7, 1, "t", 2, "k", 0.5, 3, 4, "sp", 9)


def texts():
    """Words of a small vocabulary with copies, near copies, shared passages, junk and odd texts."""
    r = random.Random(5)
    vocab = [a + b for a in ("al", "be", "co", "du", "en") for b in ("ra", "li", "mo", "nu", "tex", "sor")]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base = say(70), say(120)
    out = [say(r.randint(20, 200)) for _ in range(40)]
    out += [base] * 6 + [base.replace(base.split()[5 * k], "changed", 1) for k in range(1, 6)]
    out += [f"{say(30)} {passage}\n{say(20)}" for _ in range(5)]
    out += ["", None, " \t\n", "one", "two words", "one", "Ünïcode ÇA va 中文 😀 ok", "the&&& of%%% " * 30, "Shti " * 200, say(20_000), "a" * 3000]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [_row(i, t, ("en", "fr", None)[i % 3], ("s1", "s1", "s2", None)[i % 4]) for i, t in enumerate(texts())]
    rows += [_row(3, rows[3][1], rows[3][2], rows[3][3]), _row(None, "no id here at all", None, None), _row(4, "another text for the same id", "en", "s1")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i % 9 == 8 else 1, 0) for i in range(0, 55)] + [(None, 1, 0), (1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark, docs):
    long = texts()[2]
    words = long.split()
    return spark.createDataFrame([(1, " ".join(words[3:25]).upper()), (2, "two words"), (3, None), (4, "..."), (5, " ".join(words[5:18])), (5, " ".join(words[5:18])), (None, "one")], "item_id long, text string")
