import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, repeats inside, odd characters, nulls and empties."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 300)) for _ in range(25)]
    passage = prose(rng, 90)
    out = list(base)
    out += [base[0], base[0], base[1]]
    near = base[2].split(" ")
    near[len(near) // 2] = "changed"
    out.append(" ".join(near))
    out += [f"{prose(rng, 20)} {passage}\n{prose(rng, 15)}" for _ in range(6)]
    out.append(f"{passage} {passage}")
    out.append("la " * 200)
    out.append("x" * 700)
    out.append("né ümlaut — 漢字 " * 40)
    out += [None, None, "", " \t\n ", "one", "<|endoftext|> a  b\n\n c 　 d"]
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, home int, kind string, key string, rep long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents; some columns have names that the operators use inside, and one row stands twice."""
    rows = [(i * 3 + 1, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None, 1, "k", "x", 5) for i, t in enumerate(texts)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*out, out[4]]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
