"""Small tables with what real ones bring: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHING = ["tag", "fp", "bucket", "digest", "depth", "grp", "bits", "label", "score", "wanted", "n", "size", "row", "__m", "__id", "__digest", "__doc_id", "__tag", "id", "times", "copy", "part", "ranges"]


def texts(n=60, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgäé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i, t in enumerate(made):
        if i % 7 == 3:
            t = made[i - 1]
        elif i % 7 == 4:
            t = t + " " + passage + " " + t[:30]
        elif i % 7 == 5:
            t = made[i - 1].replace(words[0], "zz", 1) + " x"
        elif i % 11 == 6:
            t = t[:40] + "\n" + t[:40] + "\n\t" + t[:40]
        out.append(t)
    return out


def rows(n=60, seed=3):
    """(doc_id, text, lang, source, n_chars)."""
    out = [(i * 3 % 401, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts(n, seed))]
    out += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t ", "en", "s1", 4), (None, "no id at all", "en", "s0", 12), (None, out[0][1], "en", "s0", 1), (1003, "word " * 3000, "en", "s0", 15000), (1004, "üñ" * 400, "en", "s0", 800), (1005, "A b  C", None, "s2", 6), (1006, "a b c", "en", None, 5)]
    return out + [out[0], out[0], out[-1], (out[1][0], "another text under an id that is taken", "en", out[1][3], 38)]


def documents(spark, data, extra=False):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if extra:
        for i, name in enumerate(CLASHING):
            df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


#: Columns of documents(..., extra=True).
WIDTH = 5 + len(CLASHING)


def key(x):
    return tuple((v is not None, v) if not isinstance(v, (list, dict)) else (True, repr(v)) for v in x)


def same(got, want):
    """Equal rows in any order."""
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
