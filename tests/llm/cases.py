"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random


def text(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ".", ","]) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns of documents, and one that clashes with the operators' own names."""
    full = [(i, t, "en" if i is None or i % 2 else "de", "s", len(t) if t is not None else None, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _key string")


def thue_morse(n: int) -> str:
    """Its first n letters and those of its complement collide under any polynomial hash with wrap-around, from n = 1,024."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def twins():
    out = []
    for n in (1024, 2048, 4096):
        one = thue_morse(n)
        out += [one, one.translate(str.maketrans("ab", "ba"))]
    return out


def odd_rows():
    rng = random.Random(3)
    long = text(rng, 30_000, 5000)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "same text here now"), (6, "same text here now"), (6, "same text here now"), (None, "no id at all"), (7, "ÀÉ ünï ﬁ 漢字 <|endoftext|> 's"), (8, "a\r\nb\x0bc"), *((10 + i, t) for i, t in enumerate(twins()))]
