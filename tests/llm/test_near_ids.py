"""Near copies among rows with null and repeated ids."""

import random

from statloom.llm import near


def test_null_and_repeated_ids(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(100)] for _ in range(4)]
    text = [" ".join(b) for b in base]
    edit = [" ".join([*b[:-1], "edit"]) for b in base]
    rows = [(None, text[0]), (None, edit[0]), (None, text[1]), (5, edit[1]), (5, text[1]), (7, text[2]), (7, edit[2]), (7, text[3]), (None, text[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = sorted(r.n_links for r in near.join(df).collect())
    assert links == [1, 1, 1, 1, 1, 1, 2, 2, 2]
    kept = sorted((r.doc_id or 0, next(i for i in range(4) if r.text in (text[i], edit[i]))) for r in near.keep_one(df).collect())
    assert kept == [(0, 0), (5, 1), (7, 2), (7, 3)]
