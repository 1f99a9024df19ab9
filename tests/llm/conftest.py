import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows: nulls, blanks, copies, near copies, shared passages, long and periodic texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(70), prose(160)
    near = base.split()
    near[40] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, prose(49)),
        (9, f"{prose(30)} {passage} {prose(30)}"), (10, f"{prose(5)}\n{passage}\t{prose(80)}"), (11, f"{passage} {passage}"), (12, "ab " * 400), (13, "ab " * 60),
        (14, "x" * 700), (15, f"é{passage}ñ 　 日本語 {passage}"), (16, prose(4000)), (17, f"{passage.upper()} tail"), (18, "line a b\nline a b\n| x | y | z |\n" + prose(40)),
        (19, "<|endoftext|> it's  two   spaces\r\n\r\n and more "), (20, passage), (2000000000000, passage), (0, base), (None, base), (None, None),
    ]
    return rows + [(100 + i, prose(rng.randint(1, 120))) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with the other columns of documents, two of them named like columns inside the operators."""
    rows = [(i, t, "en", None if n % 7 == 0 else f"src{n % 4}", len(t or ""), n, "x") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos long, sh string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
