import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Small documents with exact and near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = say(60)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(texts) < 6:
            t = say(rng.randint(5, 120))
        elif kind == 1:
            t = list(rng.choice(texts))
        elif kind in (2, 3):
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind == 4:
            t = say(20) + passage + say(rng.randint(0, 40))
        else:
            t = say(rng.randint(0, 4))
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    long = " ".join(say(6000))
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n\t "), (n + 3, "one"), (n + 4, "one"), (n + 5, long), (n + 6, long + " x"), (None, "null identifier here"), (3, rows[3][1]), (n + 7, "Été ÇA l'été — ÉTÉ 12,5% Ünïcode"), (n + 8, "été ça l'été — été 12,5% ünïcode")]
    langs = ["en", "de", None]
    return [(d, t, langs[i % 3], [None, "b", "a", "a"][i % 4], len(t or "")) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
