"""A small corpus with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

VOCABULARY = ["the", "of", "river", "stone", "Lamp", "blue", "ran", "quick", "öl", "ñandú", "tree", "x1", "over", "Night", "calm", "zeta"]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def corpus():
    rnd = random.Random(11)
    passage = sentence(rnd, 25)
    base = sentence(rnd, 120)
    texts = [sentence(rnd, rnd.randint(1, 90)) for _ in range(25)]
    texts += [None, "", " \n\t ", "word", "two words", "The RIVER ran", base, base, base.replace("river", "River")]
    for k in range(8):  # near copies, a chain of growing edits
        words = base.split(" ")
        for j in range(k):
            words[(17 * j + 5 * k) % len(words)] = f"edit{j if k % 2 else k * 10 + j}"
        texts.append(" ".join(words))
    texts += [sentence(rnd, 20) + "\n" + passage + "  " + sentence(rnd, 9) for _ in range(5)]
    texts += [sentence(rnd, 9000), passage, "The The The " * 40, "line a b c\nline a b c\nline a b c\n" + sentence(rnd, 30)]
    texts += ["a b c" + chr(0x1F600) + " d", "# $ % " * 30]
    rows = [(i * 3 + 1, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, "clash") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, base, None, None, "no id"))
    rows.append((None, None, None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, slot string"


def documents(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
