"""Secrets in paths, flags and names; ordinary paths, flags and names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm import secrets

KEY = "q8Rt2LmZx0Pv7WsK3jHd9Yb4"
B64, B64URL = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + x for x in ("+/", "-_"))
SECRET = [
    f"https://hooks.example.org/services/T02AB3CD4/B05EF6GH7/{KEY}",
    f"run --auth={KEY} now",
    f"APP__PART={KEY}",
    f"export _KEY_={KEY}",
    "wget /files/9A8B7C6D5E4F30211203F4E5D6C7B8A9",
    "run --Auth=q8rt2lmzx0pv7wsk3jhd9yb4",
    "-" + KEY,
    KEY + "//" + KEY,
]
PLAIN = [
    "/usr/local/lib/python3/site-packages/numpy/core",
    "/usr/lib/x86_64-linux-gnu/libstdc",
    "--max-old-space-size=4096 --no-warnings",
    "/2024/01/02/Some-Title-Of-An-Article-2",
    "__init_subclass_hook_v2__",
    "/api/v1beta1/items/550e8400-e29b-41d4-a716-446655440000",
    "-" * 60_000 + "=" * 60_000,
    "-=" * 60_000 + "a1",
]


def test_secrets_in_paths_flags_and_names(spark):
    df = spark.createDataFrame(list(enumerate([*SECRET, *PLAIN])), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [i for i in got if got[i].entropy] == list(range(len(SECRET)))
    kept = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert not any(KEY in kept[i] for i in range(len(SECRET)))
    assert all(kept[len(SECRET) + i] == t for i, t in enumerate(PLAIN))


def test_random_keys_are_found(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a, n in ((B64, 40), (B64URL, 43)) for _ in range(300)]
    keys = [k for k in keys if any(map(str.isdigit, k)) and any(map(str.islower, k)) and any(map(str.isupper, k))]  # the class of keys
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")
    lost = [r.doc_id for r in secrets.scan(df).collect() if not (r.entropy or r.assign or r.access or r.hex)]
    assert lost == []


def _entropy(value: str, size: int = 20) -> float:
    from collections import Counter
    from math import log2

    return max(-sum(c / size * log2(c / size) for c in Counter(value[i : i + size]).values()) for i in range(len(value) - size + 1))


def test_window_entropy_is_that_of_every_window(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(a) for _ in range(n)) for n in (20, 21, 39, 64, 300) for a in ("ab", "0123456789abcdef", secrets.ALPHABET)]
    values.append("a" * 50)
    got = {r["v"]: r["h"] for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.window_entropy(F.col("v")).alias("h")).collect()}
    for v in values:
        assert got[v] == pytest.approx(_entropy(v), abs=1e-9)


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000))
    many = "token=abcdefgh1 x " * 2_000
    rows = spark.createDataFrame([(1, f"see {key} there"), (2, many)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(rows)).collect()}
    assert got[1]["spans"] == f"entropy:4:{4 + len(key)}"
    at = [m.span() for m in re.finditer("token=abcdefgh1", many)]
    assert got[2]["n_assign"] == 2_000 and got[2]["spans"] == ",".join(f"assign:{s}:{e}" for s, e in at)
