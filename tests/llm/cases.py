"""Small tables with the awkward rows: nulls, empty and long texts, copies, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long, id string"


def rows(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "ünï", "中文", "x1", "it's", "a,b", "#tag"]
    sentence = lambda k: " ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(k))
    passage, texts = sentence(70), []
    for _ in range(n):
        texts.append(sentence(rnd.randint(1, 160)))
    for k in range(8):  # near copies
        base = texts[k * 2].split(" ")
        base[rnd.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
    texts += [f"{sentence(5)} {passage} {sentence(9)}" for _ in range(6)] + [passage, passage.upper()]
    texts += [texts[3], texts[3], "", " \t\n", None, "one", "one two three", "ONE two three", "de " * 200, "line\nline\nother\n" * 30, "no break   spaces\r\n", "<|endoftext|> special", "y" * 5000]
    out = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (7, "same id, other text"), (None, texts[4]), (None, None)]
    rnd.shuffle(out)
    return [(i, t, rnd.choice(["en", "de", None]), "s", 0, "d", 1, "z") for i, t in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
