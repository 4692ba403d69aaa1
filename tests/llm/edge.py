"""Small tables with everything that is awkward, and clashing extra columns."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "kept boolean, shard int, slot bigint, part int, head boolean, n bigint, h bigint, node bigint, "
    "key bigint, fingerprint string, n_lines bigint, n_words bigint, block bigint, src int, uses int"
)
EXTRA = (None, 7, 7, 7, None, 7, 7, 7, 7, "x", 7, 7, 7, 7, 7)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(words):
        word = rng.choice(vocab)
        out.append(word + (rng.choice([".", ".\n", ". "]) if i % 9 == 8 else ""))
    return " ".join(out)


def rows():
    long = prose(1, 9000)
    base = prose(2, 120)
    texts = [
        (1, ""),
        (2, None),
        (None, "alpha beta gamma delta epsilon zeta"),
        (None, None),
        (3, "word"),
        (4, long),
        (5, base),
        (5, base),
        (6, base),
        (7, base + " and more"),
        (8, "a\nb\na\n\n\nb\r\na"),
        (9, "x" * 5000),
        (-4, "Ünïcode 漢字 🎈 ß.     end"),
        (10, " \t\n\x0b\x0c\r "),
        (11, prose(3, 200)),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang, source = (None, None) if i % 5 == 0 else (f"l{i % 2}", f"s{i % 3}")
        out.append((doc, text, lang, source, None if text is None else len(text), *EXTRA))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
