"""Inputs shared by the operators' tests."""

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node string, rep string, root string, f0 string, anchor string, seed string, tokens string, epoch string, spans string"


def words(n: int, seed: int, vocabulary: int = 5000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    """Nulls in every column, empty, blank, wordless and very long texts, ties and repeats."""
    long = words(30_000, 1)
    out = [
        (1, words(80, 2), "en", "a"),
        (2, words(80, 2), "en", "a"),
        (2, words(80, 2), "en", "a"),
        (3, None, "en", "a"),
        (4, "", "en", None),
        (5, "   \n\t ", None, "b"),
        (6, "### %%% !!!", "de", "b"),
        (7, "### %%% !!!", "de", "b"),
        (8, long, "en", "b"),
        (9, "x" * 300_000, "en", "b"),
        (None, words(80, 2), "en", "a"),
        (None, None, None, None),
        (10, words(60, 3) + " Ünïcode é 漢字 " + words(60, 4), "fr", "a"),
        (11, "one", "fr", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) + ("x",) * 9 for i, t, lang, s in out]


#: Legal columns whose names clash with SQL, with each other once dots are split, or with the operators' own.
ODD = "`meta.url` string, `a``b` map<string,string>, _id long, _taken int, _row string, epoch int, taken int, x0 string, hit int, count int, h long, cell long, removed_words int"


def odd_docs(spark, data=None):
    """The rows of ``docs`` with odd columns, MAP ones too, and doc_id 2 repeated with another text and without."""
    source = rows() if data is None else data
    extra = [r[:5] for r in source]
    if data is None:
        extra += [(2, "a second text", "en", "a", 13), (2, None, "en", "a", None)]
    return spark.createDataFrame([(*r, f"u{k}", {"k": str(k)}, *([k] * 2), "r", 5, 6, "y", *([k] * 5)) for k, r in enumerate(extra)], f"doc_id long, text string, lang string, source string, n_chars long, {ODD}")


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, CLASHING)


def simple(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
