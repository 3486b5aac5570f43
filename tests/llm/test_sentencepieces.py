"""Agendas that run side by side."""

import random

import numpy as np

from fanloom.llm import sentencepieces


def test_agendas_side_by_side_equal_the_heap_and_the_library():
    rng = random.Random(12)
    v = sentencepieces.Vocabulary()
    texts = ["".join(rng.choice(" abcétheing中文ガ▁🙂\n\t01_-'𝒳\x00²ǅʰ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "中" * 3000, "a" * 2000 + "🙂" * 50, "x" * 32, "y" * 33, "the " * 400_000]
    got = v.encode_many(texts)
    want = sentencepieces._library(sentencepieces.VOCABULARY).encode([t or "" for t in texts], num_threads=1)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == want
    units = sorted({u for t in texts[:3000] for u in v.units(t)})
    short = [u for u in units if len(u) <= sentencepieces._SHORT]
    assert [np.array(v.agenda(u), np.int32).tobytes() for u in short] == v.agendas(short) and v.agendas([]) == []
    for ids, t in zip(got, texts):
        decoded, begin = v.decode_bytes(np.frombuffer(ids, np.int32))
        assert v.plain(decoded.tobytes()).decode() == (t or "").replace("▁", " ") and begin[-1] == len(decoded)
