"""Small tables that the tests of the training-data operators share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names the operators use inside.
CLASHING = SCHEMA + ", id long, key string, token string, n long, sig string, label string, size long, score string, held_out string, leaks string, host string, path string, rule string"


def words(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 6))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Distinct texts, exact copies, near copies, a shared passage, short, empty and null ones, and repeated rows."""
    base, passage = [words(i, 90) for i in range(6)], words(99, 60)
    near = base[0][:]
    near[40] = "changed"
    texts = [" ".join(b) for b in base] + [" ".join(base[0]), " ".join(base[0]), " ".join(near)]
    texts += [" ".join(base[4][:30] + passage + base[5][:30]), " ".join(base[2][:20] + passage), "", None, "one two three", "One TWO three", "x", " \t\n ", "éa öü ß 日本 " * 30]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[1], rows[1], rows[3], (None, "no id here", None, None, None), (500, " ".join(words(7, 12_000)), "en", "a", 1)]


def documents(spark, clashing: bool = False):
    if not clashing:
        return spark.createDataFrame(corpus(), SCHEMA)
    return spark.createDataFrame([(*r, 1, "k", "t", 2, "s", "l", 3, "sc", "h", "le", "ho", "p", "r") for r in corpus()], CLASHING)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
