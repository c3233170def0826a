"""Small documents with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk long, row string, score double"
WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all".split()


def words(rng, n, unique=0.3):
    return " ".join(rng.choice(WORDS) if rng.random() > unique else f"w{rng.randint(0, 10 ** 6)}" for _ in range(n))


def texts(seed=1, n=60):
    """Documents with copies, near copies, shared passages and odd texts, by id."""
    rng = random.Random(seed)
    passage = words(rng, 40, 0.6)
    out = {}
    for i in range(n):
        kind = i % 6
        base = words(rng, rng.randint(30, 120))
        if kind == 1 and i > 6:
            base = out[i - 6] or ""
        elif kind == 2 and i > 6:
            w = (out[i - 6] or "a b").split()
            w[rng.randrange(len(w))] = "changed"
            base = " ".join(w)
        elif kind == 3:
            base = f"{words(rng, 15)}\n{passage}\n{words(rng, 20)}"
        out[i] = base
    out |= {n: None, n + 1: "", n + 2: "  ", n + 3: "word", n + 4: "Éa ñu. ①\t漢字 \x00 '", n + 5: words(rng, 6000), n + 6: "ab" * 4000, n + 7: "word"}
    return out


def documents(spark, seed=1, n=60):
    rows = [(i, t, "en", "s", len(t or ""), 7, "r", 0.5) for i, t in texts(seed, n).items()]
    rows += [(None, "an id is missing here and the text stays", None, None, None, None, None, None)] + rows[-3:-2]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
