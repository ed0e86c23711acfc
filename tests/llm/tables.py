"""A small table with all the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp string, line int, score double"
WORDS = {"en": "the and of to in that with house water under light", "de": "der die und ist nicht haus wasser unter licht auch für", "fr": "le la et est dans maison eau sous lumière avec très"}


def documents(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = WORDS[lang].split()
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 7))]
        if i % 9 == 0:
            lines[1:1] = ["shared line one", "shared line two", "shared line three", "shared line four"]
        out.append((i, "\n".join(lines), lang if i % 11 else None, f"src{i % 3}" if i % 13 else None))
    out[10] = (10, out[20][1], out[20][2], "src1")
    out[30] = (30, out[20][1], out[20][2], "src1")
    out += [(n, None, "en", "src0"), (n + 1, "", None, None), (n + 2, " \n\t", "en", "src2"), (n + 3, "12 34 -- !!", "en", "src0"), (n + 4, " ".join(rng.choice(WORDS["en"].split()) for _ in range(30_000)), "en", "src1"), (None, "the house of water and light", "en", "src1"), out[5], (n + 5, "a", "en", "src0"), (n + 6, "\n\n\n\n\n", "en", "src0")]
    return [(d, t, g, s, len(t) if t is not None else None, 7, 3, "x", 1, 0.5) for d, t, g, s in out]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
