"""A small corpus with copies, near copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, fp int, marks double"


def texts(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop é") for _ in range(rnd.randrange(2, 9))).strip() or "x" for _ in range(600)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage, line = prose(70), prose(14)
    out = [prose(rnd.choice([3, 12, 60, 200])) for _ in range(40)]
    out += [out[5]] * 12 + [out[30] + " tail"] * 3
    for i in range(25):
        near = out[39 - i % 3].split(" ")
        near[rnd.randrange(len(near))] = "edited"
        out.append(" ".join(near))
    out += [f"{prose(20)}\n{passage} {prose(9)}\n{line}" for _ in range(15)]
    out += ["", None, " \t\n", "one", "a b c", "ab " * 400, "y" * 900, passage + "\n" + passage, "é" * 300, "Á\x0b\x0cB\rC  D",
            prose(6000)]
    return out


def rows():
    """(doc_id, text) with ids out of order, a null id, and rows that come twice."""
    found = texts()
    ids = list(range(1000, 1000 + len(found)))
    random.Random(3).shuffle(ids)
    out = list(zip(ids, found, strict=True))
    return [*out, out[3], out[60], (None, found[41]), (None, None)]


def frame(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "g", 1, 0.5) for d, t in pairs], SCHEMA)
