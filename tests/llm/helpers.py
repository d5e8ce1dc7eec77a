"""Small tables with the odd rows that every operator must take."""

import random

#: Among the columns are names that operators use for their own ones.
CLASHING = {"tag": 3, "spans": "s", "_touched": "t", "_bit": 7, "_n": 8, "n": 9, "_masks": "keep", "_pieces": "p", "_candidates": "c", "_scores": 1.5, "_group": 2, "group": 4, "bins": 5, "bound": 6, "offset": 10, "sequence_id": 11, "done": "d", "predicted": 12, "score": 0.25, "path": "x", "none": 1, "k": 2, "at": 3, "extra": "x", "h1": 1, "h2": 2, "size": 3, "a.b": 4}
KINDS = {int: "long", str: "string", float: "double"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {KINDS[type(v)]}" for k, v in CLASHING.items())


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(2 + (r.randrange(vocabulary) % 7))) for _ in range(n))


def rows():
    """Nulls, empty and blank texts, exact and near copies, shared passages, repeated rows, odd characters, one long text."""
    base, passage = words(1, 200), words(2, 40)
    near = base.split()
    near[50] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, words(3, 80) + " " + passage + " " + words(4, 60)), (5, passage + "\n" + words(5, 90)), (6, ""), (7, None), (8, "   \n "), (9, "one two"),
        (10, "one two"), (None, base), (12, words(6, 20_000)), (13, "ｆｕｌｌ １２ 日本語 😀 e\u0301 \x00 \u2581 a\u2028b"), (14, words(7, 12)), (15, words(8, 13)), (16, words(8, 13)),
        (17, "token = \"" + "0a1b2c3d4e" * 4 + "\" and commit " + "9f8e7d6c5b" * 4), (20, words(9, 30)), (20, words(9, 30)), (21, words(11, 30)), (21, words(12, 30)), (-5, passage), (2**40, words(13, 50)),
    ]
    return [(i, t, "en", "src1", None if t is None else len(t), *CLASHING.values()) for i, t in out]


def untouched(rows):
    """Whether the columns that an operator hands on have their values."""
    return all(r["lang"] == "en" and r["source"] == "src1" and all(r[k] == v for k, v in CLASHING.items()) for r in rows)


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents_only(spark, name, tmp_path, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
