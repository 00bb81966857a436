import random

import numpy as np
import pyarrow as pa

from akin.config import PRIME, permutations
from akin.functions import signature
from akin.functions.signature import Permuter, signed_texts
from akin.functions.text import id_set_and_bytes


def test_texts_signed_together_have_their_own_signatures(monkeypatch):
    monkeypatch.setattr(signature, "GROUP_IDS", 300)
    monkeypatch.setattr(signature, "ALONE", 150)
    draw = random.Random(5)
    texts = [None, "", "ab", *("".join(draw.choices("abc ", k=draw.randrange(400))) for _ in range(40)), "abcd" * 9]
    texts.append("".join(map(chr, range(97, 400))))
    got = signed_texts(pa.array(texts), 4, "exact", Permuter(permutations(16))).field("sig").to_pylist()
    for text, found in zip(texts, got, strict=True):
        ids = id_set_and_bytes(text or "", 4)[0].view(np.uint64) & np.uint64(PRIME)
        assert found == ([min((a * int(x) + b) % PRIME for x in ids) for a, b in permutations(16)] if len(ids) else None)


def test_a_shingle_that_texts_share_is_permuted_once(monkeypatch):
    permuted = []
    values, sign = Permuter.values, Permuter.sign
    monkeypatch.setattr(Permuter, "values", lambda self, ids: permuted.append(len(ids)) or values(self, ids))
    monkeypatch.setattr(Permuter, "sign", lambda self, ids: permuted.append(len(ids)) or sign(self, ids))
    signed_texts(pa.array(["the same words again"] * 50), 4, "exact", Permuter(permutations(8)))
    assert sum(permuted) == 17
