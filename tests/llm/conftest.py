import random

import pytest

LANG = {"en": "the of and to in is that for it was ed ing tion er est ly ble and wh th".split(), "fr": "le la de et un que pour dans sur eau oi ment eux elle tre ée ai ou".split()}


def sentence(r, lang="en", n=40):
    return " ".join("".join(r.choice(LANG[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts of all kinds: plain, copies, near copies, shared passages, repeats, marks, empty, null, very long."""
    r = random.Random(5)
    out = [sentence(r, r.choice(["en", "fr"]), r.randint(5, 120)) for _ in range(60)]
    passage = sentence(r, n=60)
    out += [sentence(r) + " " + passage + " " + sentence(r) for _ in range(8)]
    out += [out[3]] * 4
    base = out[60].split()
    for i in range(6):
        w = list(base)
        w[7 * i % len(w)] = f"changed{i}"
        out.append(" ".join(w))
    out += [None, "", "   \n\t ", "a", "a b", "a b c", "É", "same " * 300, "x" * 5000, "tab\there\x0bnow\x0cthen\r\n\r\nend  ", "日本語 テキスト 😀", sentence(r, n=9000), sentence(r, n=12) + "\n" + sentence(r, n=12)]
    out += [out[-1], None]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids, sources and columns whose names clash with those inside."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), i, f"k{i}", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(docs):
    """Every row twice, and rows with a null id."""
    from pyspark.sql import functions as F

    return docs.unionByName(docs).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
