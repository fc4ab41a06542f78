"""Rows with everything that an operator must take: nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


LONG = prose(99, 30_000)
ROWS = [
    (0, prose(1, 120), "en", "a", 1), (1, prose(1, 120), "en", "b", 1), (2, prose(2, 60) + "\n" + prose(1, 60), "fr", "a", 1),
    (3, "", "en", "a", 0), (4, None, "en", None, None), (5, "  \n\t ", None, "c", 3), (6, LONG, "en", "d", len(LONG)),
    (7, "one two", "en", "a", 7), (7, "one two", "en", "a", 7), (7, prose(3, 50), "en", "a", 7), (None, prose(4, 40), "en", "a", 1),
    (None, None, None, None, None), (8, "wörd " * 400, "de", "b", 2000), (9, "日本語 テキスト\x1c x y", "ja", "😀", 9), (10, prose(1, 119) + " changed.", "en", "b", 1),
    (11, "\n".join(f"Bonjour\u00a0{k} le chat dort" for k in range(30)), "fr", "a", 1), (12, "\n".join(f"Oui\u00a0{k}\u2028a b\u0085c d\u00a0?" for k in range(30)), "fr", "a", 1), (13, "\n".join(f"ÉTÉ\u00a0{k} ÇA VA ß\u3000!" for k in range(30)), "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["t", "s", "z", "row", "_row", "_n", "size", "target", "taken", "bucket", "spans", "node", "length", "key", "payload", "digest", "score", "_mix", "_weft_t"]


def frame(spark, rows=ROWS, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH}) if extra else df


def key(row):
    return tuple((x is None, x) for x in row)
