"""Redaction against the spans that were planted, and on odd texts."""

import random
import time

from fanloom.llm import pii


def test_planted_spans_are_found_and_harmless_sentences_stay():
    """Held-out sentences of another seed; recall is counted over all planted spans, proposed or not."""
    r, rng = pii.redactor(), random.Random(99)
    made = [pii._made(rng) for _ in range(1500)]
    found = r.spans([t for t, _ in made])
    planted = hit = wrong = total = 0
    for (text, spans), got in zip(made, found):
        planted += len(spans)
        hit += sum(any(a < e and s < b for a, b, _, _ in got) for s, e, _ in spans)
        total += len(got)
        wrong += sum(not any(a < e and s < b for s, e, _ in spans) for a, b, _, _ in got)
    assert planted > 1000 and hit / planted > 0.97 and wrong / total < 0.05


def test_numbers_and_words_next_to_a_number_hide_none():
    r = pii.redactor()
    texts = ["pay card 4111111111111111 12 times", "card 4111 1111 1111 1111 24", "my iban GB82 WEST 1234 5698 7654 32 AND MORE WORDS", "card 12 4111 1111 1111 1111"]
    for text, want in zip(texts, ["4111111111111111", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"]):
        assert want in [text[s:e] for s, e, _ in pii.candidates(text)], text
        if not text.startswith("card 12"):  # a number right before one is proposed apart from it, but trees may still reject it
            assert want not in r.redact(text, r.spans([text])[0])


def test_unspaced_texts_take_linear_time():
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghij中文") for _ in range(1 << 20))
    text = "".join(letters[k : k + 200] + str(k % 10) for k in range(0, 1 << 20, 200))
    r = pii.redactor()
    begin = time.process_time()
    (found,) = r.spans([text + " a.22@mail3.example.com"])
    assert time.process_time() - begin < 10
    assert found[-1][2] == "email"
