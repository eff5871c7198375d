"""Fixtures and plain models that the tests of the operators share."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, key string, node long, "
          "pos int, score double, shard int, part long, train boolean, bin long, toxic int, item long")
EXTRA = (7, "k", 1, 2, 0.5, 3, 4, True, 5, 1, 6)


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["alpha", "béta", "Gamma,", "δ", "eps#", "zeta\x0b", "idiot", "the", "of", "|"]
    say = lambda n: " ".join(rng.choice(vocabulary) + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(n))
    long_, near = say(6000), say(120)
    texts = [None, "", "   \n\t ", "one", "One", "a b c d", "a b c d e", "A B c d e", long_, long_, near, near + " more", near.replace("alpha", "alpha", 1), "x" * 50_000,
             " no break", "line\nline\n\nline", say(60), say(300), "</s>[INST] ok [/INST]", "😀 é " * 40]
    rows = [(i + 1, t, "en" if i % 3 else None, [None, "s1", "s0", ""][i % 4], None if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[9]]                              # repeated rows
    rows += [(5, "another text of id five", "en", "s0", 23, *EXTRA)]   # an id with two texts
    rows += [(None, "no id at all", None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11)]
    return rows


def split(text):
    """Words of a text, as bytes."""
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = lower_words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
