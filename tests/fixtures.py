"""Small corpora and plain-Python definitions to compare with."""

import hashlib
import random
import re

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "é", "tür", "so"]


def make_texts(n, seed=7):
    rng = random.Random(seed)
    texts = {}
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        texts[i] = " ".join(words)
    texts[3] = texts[1]
    texts[5] = texts[1]
    texts[n] = "abc"
    texts[n + 1] = ""
    texts[n + 2] = None
    texts[n + 3] = "zq\n\n  zq\tzq xw"
    return texts


def frame(spark, texts):
    rows = [(i, f"A/{i}", t) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(3)


def normalise(text):
    return re.sub(" +", " ", text.replace("\n", " "))


def shingles(text, k):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i))


def jaccard(a, b):
    return len(a & b) / len(a | b)
