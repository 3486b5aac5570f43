"""Redaction of personal data and secrets: candidate spans, boosted trees, calibrated thresholds.

Generators of high recall propose spans, which may overlap, near places that have a digit, an at sign or a word like
``token``. Each candidate gets format features (lengths, classes of characters, check digits, ranges, entropy) and
context features (words and characters around it). Gradient-boosted trees, trained here on sentences made with a fixed
seed, score them; isotonic regression on held-out candidates turns scores into probabilities, and each kind has the
threshold of best F1 on them. Of overlapping candidates over their thresholds the one of highest score (ties: the
longest, then the first) is redacted, with its kind in brackets.

Kinds: email, phone, ip, card, ssn, iban, secret. Noise between the groups of a phone number doesn't hide it.

Defined cases
    null text: stays null, no spans. Empty text: stays. Null doc_id: like any other. Repeated rows: each is redacted.
    Ties: as above. Very long texts, without any white space too: whole, in linear time. Empty table: no rows. Further columns: ignored by ``redact``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fanloom.llm import boost

TRAINING = 6000
_ANCHOR = re.compile(r"[0-9@]|[tT](?:oken|OKEN)|[pP](?:assw|ASSW|wd|WD)|[sS](?:ecret|ECRET)|[kK](?:ey|EY)\b|[bB](?:earer|EARER)")
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "secret")
_GENERATORS = (
    ("email", re.compile(r"[\w.+-]{1,64}@(?:[^\W_]|-){1,63}(?:\.(?:[^\W_]|-){1,63}){1,5}")),
    ("phone", re.compile(r"(?<![\w.])\+?\d{1,3}[^\w\n]{0,6}\d{2,4}[^\w\n]{1,6}\d{3,4}(?:[^\w\n]{1,6}\d{2,4}){0,3}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.+])\(?\d{3}\)?[^\w\n]{1,6}\d{3}[^\w\n]{1,6}\d{4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])\+\d{1,3}[^\w\n]{0,6}\d{3}[^\w\n]{1,6}\d{3}[^\w\n]{1,6}\d{4}(?!\w)")),
    ("phone", re.compile(r"(?<!\w)\+\d{8,15}(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<![\w.])\d(?:[ -]?\d){11,18}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")),
    ("secret", re.compile(r"(?<![\w/+=-])[A-Za-z0-9_/+=-]{16,}(?![\w/+=-])")),
    ("secret", re.compile(r"(?i)(?:token|passw(?:or)?d|pwd|secret|key|bearer)[\"']?\s{0,3}[=: ]\s{0,3}[\"']?([^\s\"']{6,})")),
)
_CARD, _IBAN = (next(k for k, (name, _) in enumerate(_GENERATORS) if name == kind) for kind in ("card", "iban"))
_GROUP, _BLOCK, _SPACE = re.compile(r"\d+"), re.compile(r"\S+"), re.compile(r"\s")
_HINTS = {
    "card": ("card", "visa", "credit", "mastercard", "amex", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax", "dial"), "ip": ("ip", "host", "server", "address", "from"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"), "secret": ("token", "password", "passwd", "secret", "key", "bearer", "pwd", "credential"), "email": ("mail", "email", "contact", "write"),
}
_AGAINST = ("version", "order", "invoice", "ref", "isbn", "section", "chapter", "page", "commit", "tracking", "serial", "item", "release", "v", "no", "figure", "sku")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = re.sub(r"\s", "", iban).upper()
    try:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of the spans that any generator proposes, in time linear in the text.

    Card numbers are proposed from every group of digits to every other with 12 to 19 digits, account numbers up to every
    blank, so that numbers or words next to them hide none."""
    spans: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        last = spans[-1][1] if spans else 0
        if m.end() + 80 <= last:
            continue
        a, space = max(0, m.start() - 80), _SPACE.search(text, min(len(text), m.end() + 80))
        while a > last and not text[a - 1].isspace():
            a -= 1
        b = space.start() if space else len(text)
        if spans and a <= last:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for a, b in spans:
        for g, (_, pattern) in enumerate(_GENERATORS):
            for m in pattern.finditer(text, a, b):
                s, e = m.span(m.lastindex or 0)
                if g == 0:
                    while text[s] in ".-+" and s < e - 1:
                        s += 1
                if e > s:
                    out.append((s, e, g))
                if g == _CARD:
                    groups = [x.span() for x in _GROUP.finditer(text, s, e)]
                    out += [(i, j, g) for k, (i, _) in enumerate(groups) for _, j in groups[k:] if 12 <= sum(map(str.isdigit, text[i:j])) <= 19]
                elif g == _IBAN:
                    out += [(s, x.end(), g) for x in _BLOCK.finditer(text, s, e) if 15 <= len(text[s : x.end()].replace(" ", "")) <= 34]
    return sorted(set(out))


def features(text: str, s: int, e: int, g: int) -> list[float]:
    span = text[s:e]
    kind = _GENERATORS[g][0]
    digits = re.sub(r"\D", "", span)
    letters = sum(c.isalpha() for c in span)
    counts = Counter(span)
    n = len(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before = re.findall(r"[A-Za-z]+", text[max(0, s - 40) : s].lower())[-4:]
    after = text[e : e + 1]
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 and (p == "0" or p[0] != "0") for p in parts)
    groups = re.findall(r"\d+", span)
    return [
        *(float(g == k) for k in range(len(_GENERATORS))),
        n, len(digits), letters, len(digits) / n, letters / n, entropy, len(counts),
        float(luhn(digits)) if len(digits) > 11 else -1.0,
        float(octets), float(max((int(x[:4]) for x in parts if x.isdigit()), default=0)) if kind == "ip" else -1.0,
        float(mod97(span)) if kind == "iban" else -1.0,
        float("@" in span), span.count("."), span.count("-"), float(span[0] == "+"), float("(" in span), len(groups), max((len(x) for x in groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", span))), float(span.isupper()), float(any(c.isupper() for c in span) and any(c.islower() for c in span)), float(bool(digits) and letters > 0),
        float(any(w in before for w in _HINTS[kind])), float(any(w in before for w in _HINTS["secret"])), float(any(w in before[-2:] for w in _AGAINST)),
        float(text[max(0, s - 1) : s] in "\"'"), float(after in "\"'" and after != ""), float(after.isalnum()), float(text[max(0, s - 1) : s].isalnum()), float("=" in text[max(0, s - 5) : s]),
        float(bool(re.search(r"\d[\d.,: /-]*$", text[max(0, s - 12) : s]))), float(bool(re.match(r"[.,:/-]?\d", text[e : e + 2]))),
        float(len(set(digits)) <= 2), float(bool(re.fullmatch(r"(?:19|20)\d\d(?:\D\d\d){2}.*", span))),
        len(re.findall(r"[^\w\s().+/:=@-]", span)), float(bool(re.search(r"\.[A-Za-z]{2,}$", span))), float(any(len(x) == 4 for x in groups[-1:]) and any(len(x) == 3 for x in groups)),
    ]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made sentence and its private spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("bcdfghlmnrst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    any_ = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            x = d(rng.choice((13, 15, 16, 16, 16, 16, 16, 19)))
            if luhn(x) == valid:
                return x if rng.random() < 0.6 or len(x) != 16 else rng.choice(" -").join(x[k : k + 4] for k in (0, 4, 8, 12))

    def iban(valid: bool) -> str:
        land = rng.choice(("DE", "FR", "ES", "GB", "NL"))
        bank = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) if land in ("GB", "NL") else ""
        body = land + "00" + bank + d(rng.randint(14 - len(bank) // 2, 23 - len(bank)))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:2] + "00")) % 97
        whole = body[:2] + f"{check if valid else (check + rng.randint(1, 90)) % 97:02d}" + body[4:]
        return whole if rng.random() < 0.6 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    octet = lambda: str(rng.randint(0, 255))
    private = {
        "email": lambda: rng.choice((f"{w()}.{d(2)}", w(), f"{w()}_{w()}", f"{w()}+{w()}")) + "@" + rng.choice((f"mail{d(1)}.{w()}.com", f"{w()}.org", f"{w()}-{w()}.co.uk", f"{w()}.net")),
        "phone": lambda: rng.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"+1-{d(3)}-{d(3)}-{d(4)}")),
        "ip": lambda: ".".join(octet() for _ in range(4)) if rng.random() < 0.85 else ":".join(hexa(4) for _ in range(8)),
        "card": lambda: card(True),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: iban(True),
        "secret": lambda: rng.choice((hexa(32), hexa(40), hexa(64), any_(rng.randint(24, 48)), "AKIA" + any_(16).upper(), "ghp_" + any_(36))),
    }
    harmless = (
        lambda: "order " + card(False), lambda: card(False), lambda: "item " + d(rng.randint(12, 18)), lambda: f"version {d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}", lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"1{d(1)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"{d(3)},{d(3)}.{d(2)}", lambda: f"pages {d(3)}-{d(3)}",
        lambda: f"CC BY-NC 4.0.", lambda: f"Apache License, Version 2.0.", lambda: f"{w()}@{w()}", lambda: "".join(w() for _ in range(6)), lambda: w() + "-" + w() + "-" + w() + "-" + w() + "-" + w(), lambda: f"/{w()}/{w()}/{w()}/{w()}.html", lambda: iban(False), lambda: "=" * rng.randint(16, 40), lambda: "-" * rng.randint(16, 40),
        lambda: f"commit {hexa(7)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: d(rng.randint(1, 9)), lambda: f"the {rng.choice(('token', 'key', 'secret', 'password'))} {w()}{w()}{w()} {w()}", lambda: f"({d(4)}) {d(2)}", lambda: f"{d(4)} {d(4)}",
    )
    parts: list[tuple[str, str | None]] = []
    for _ in range(rng.randint(2, 5)):
        parts += [(w(), None) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            if rng.random() < (0.75 if kind in ("secret", "ssn") else 0.25):
                parts.append((rng.choice(_HINTS[kind]), None))
                if kind == "secret":
                    parts.append((rng.choice(("=", ":")), None))
            parts.append((private[kind](), kind))
            while rng.random() < 0.3:  # private spans and numbers next to each other
                if rng.random() < 0.4:
                    parts.append((rng.choice(harmless)(), None))
                other = rng.choice(KINDS)
                parts.append((private[other](), other))
        else:
            parts.append((rng.choice(harmless)(), None))
    noise = rng.choice(("", "", "", "", "!!", "$$$", "%%%", "###", "***", "&&&"))
    upper = noise == "!!" or rng.random() < 0.05
    text, spans = "", []
    for value, kind in parts:
        value = value.upper() if upper else value
        quote = '"' if kind == "secret" and rng.random() < 0.6 else ""
        if noise and kind in (None, "phone"):
            value = re.sub(r" ", noise + " ", value)
        text += quote
        if kind:
            spans.append((len(text), len(text) + len(value), kind))
        text += value + quote + (noise or rng.choice(("", "", "", ",", "."))) + rng.choice(" " * 9 + "\n")
    return text, spans


class Redactor:
    """Trees, calibration and thresholds, and their use on texts."""

    def __init__(self, sentences: int = TRAINING, seed: int = 5):
        rng = random.Random(seed)
        x, y, kind, held = [], [], [], []
        for k in range(sentences):
            text, spans = _made(rng)
            truth = {(s, e): c for s, e, c in spans}
            for s, e, g in candidates(text):
                x.append(features(text, s, e, g))
                y.append(float(truth.get((s, e)) == _GENERATORS[g][0]))
                kind.append(_GENERATORS[g][0])
                held.append(k % 3 == 0)
        x, y, held, kind = np.array(x), np.array(y), np.array(held), np.array(kind)
        self.trees = boost.Trees().fit(x[~held], y[~held])
        score = self.trees.score(x[held])
        self.steps = boost.isotonic(score, y[held])
        p = boost.calibrated(self.steps, score)
        self.thresholds = {k: boost.threshold(p[kind[held] == k], y[held][kind[held] == k]) for k in KINDS}
        self.held_out = {k: self._rates(p, y[held], kind[held], k) for k in KINDS}

    def _rates(self, p, y, kind, k) -> tuple[float, float]:
        own = kind == k
        hit = p[own] >= self.thresholds[k]
        tp = (hit & (y[own] > 0)).sum()
        return float(tp / max(hit.sum(), 1)), float(tp / max((y[own] > 0).sum(), 1))

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        where, x = [], []
        for k, t in enumerate(texts):
            for s, e, g in candidates(t) if t else ():
                where.append((k, s, e, g))
                x.append(features(t, s, e, g))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if not where:
            return out
        score = self.trees.score(np.array(x))
        p = boost.calibrated(self.steps, score)
        order = sorted(range(len(where)), key=lambda i: (where[i][0], -score[i], where[i][1] - where[i][2], where[i][1]))
        for i in order:
            k, s, e, g = where[i]
            kind = _GENERATORS[g][0]
            if p[i] >= self.thresholds[kind] and all(e <= a or s >= b for a, b, _, _ in out[k]):
                out[k].append((s, e, kind, float(p[i])))
        for spans in out:
            spans.sort()
        return out

    def redact(self, text: str, spans) -> str:
        done, parts = 0, []
        for s, e, kind, _ in spans:
            parts += [text[done:s], f"[{kind.upper()}]"]
            done = e
        return "".join([*parts, text[done:]])


@lru_cache(1)
def redactor(sentences: int = TRAINING) -> Redactor:
    return Redactor(sentences)


def redact(docs: DataFrame, sentences: int = TRAINING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_redacted, spans): texts with private spans replaced; places count characters of the input."""
    shared = docs.sparkSession.sparkContext.broadcast(redactor(sentences))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("p", pa.float64())]))

    def run(batches):
        r = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                texts = own.column(1).to_pylist()
                found = r.spans(texts)
                new = [None if t is None else r.redact(t, f) if f else t for t, f in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(new, pa.string()), pa.array([len(f) for f in found], pa.int32()), pa.array([[{"start": s, "end": e, "kind": k, "p": p} for s, e, k, p in f] for f in found], span)],
                    names=["doc_id", "text", "n_redacted", "spans"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text string, n_redacted int, spans array<struct<start:int,end:int,kind:string,p:double>>"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(spark.read.parquet(f"{sf_dir}/documents.parquet"), TRAINING)
