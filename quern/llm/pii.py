"""Operator 5: personal data, from overlapping candidates judged by calibrated boosted trees."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.ship import ship
from quern.llm.exchange import slices
from quern.llm.tree import Boosted
from quern.llm.words import buffer

# The base formats. The base's spans are always kept.
BASE = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CLASS = np.zeros(128, bool)
_LOCAL_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
# Generators beyond the base, of high recall; their candidates are kept only if the trees are sure.
MORE = {
    "email_words": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[\[({]?\x20?(?:at|AT)\x20?[\])}]?\x20?[A-Za-z0-9-]{2,63}\x20?[\[({]?\x20?(?:dot|DOT)\x20?[\])}]?\x20?[A-Za-z]{2,10}(?![A-Za-z])"),
    "phone_local": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "social": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card_loose": re.compile(r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
}
KINDS = (*BASE, *MORE)
CUES = {  # words of the context that speak for a kind, in four languages
    "email_words": "mail email e-mail contact write correo courriel schreib",
    "phone_local": "phone tel call mobile fax telefon teléfono téléphone appel anruf",
    "social": "ssn social security sozial seguridad sécurité",
    "iban": "iban account bank konto cuenta compte",
    "card_loose": "card visa mastercard credit karte tarjeta carte",
}
_AGAINST = frozenset("order no number id ref invoice isbn sku part version serial nummer número numéro".split())
TRAINING = 3000  # generated labelled candidates
PRECISION = 0.95  # least calibrated probability of a span beyond the base


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind and start. Per kind: leftmost non-overlapping matches, failing ones dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := ord(text[start - 1])) < 128 and _LOCAL_CLASS[c]:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            out.append((0, start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans of the generators beyond the base; they may overlap one another and the base."""
    return [(len(BASE) + k, m.start(), m.end()) for k, pattern in enumerate(MORE.values()) for m in pattern.finditer(text)]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40):start].lower())[-4:]
    after = re.findall(r"[^\W\d_]+", text[end:end + 25].lower())[:2]
    cues = frozenset(CUES.get(KINDS[kind], "").split())
    near = [w for w in before + after if w in cues]
    sure = {"iban": lambda: _iban(span), "social": lambda: span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[-4:] != "0000"}
    return [float(kind), float(len(span)), float(len(digits)), float(luhn(digits)) if digits else 0.0, float(len(near) > 0),
            float(any(w in _AGAINST for w in before[-2:])), float(sum(c in " -.()" for c in span)), float(len(set(digits))),
            float(sure[KINDS[kind]]()) if KINDS[kind] in sure else 0.5, float("[" in span or "(" in span or "{" in span),
            float(start > 0 and text[start - 1] in "#=_/"), float(digits[:1] in ("4", "5") if digits else 0)]


def labelled(n: int = TRAINING, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A table of candidates in made-up contexts with labels, drawn by rule: right formats near their cues are personal data;
    the same formats near order numbers, and formats whose check digits fail, are not."""
    draw = random.Random(seed)
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join("".join(draw.choice("aeinorst") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(1, 4)))
    rows, labels = [], []
    while len(rows) < n:
        kind = draw.choice(list(MORE))
        right, cued = draw.random() < 0.5, draw.random() < 0.5
        if kind == "email_words":
            span = f"{filler().split()[0]} at {filler().split()[0]} dot com" if not right else f"{filler().split()[0]}{number(2)} [at] {filler().split()[0]} [dot] com"
        elif kind == "phone_local":
            span = draw.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}")).format(number(3), number(3), number(4))
        elif kind == "social":
            span = f"{draw.randint(100, 665) if right else draw.choice((0, 900)):03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}"
        elif kind == "iban":
            body = number(18)
            check = 98 - int(body + "131400") % 97
            span = f"DE{check if right else (check + 7) % 97:02d}{body}"
        else:
            body = draw.choice("45") + number(14)
            last = next(c for c in "0123456789" if luhn(body + c))
            span = body + (last if right else str((int(last) + 3) % 10))
        cue = draw.choice(CUES[kind].split()) if cued else draw.choice(sorted(_AGAINST)) if draw.random() < 0.5 else filler()
        text = f"{filler()} {cue} {span} {filler()}"
        start = text.index(span)
        found = [c for c in candidates(text) if KINDS[c[0]] == kind and c[1] <= start + 1 and c[2] >= start + len(span) - 1]
        for c in found[:1]:
            rows.append(features(text, *c))
            labels.append(float(right and cued))
    return np.array(rows), np.array(labels)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = PRECISION) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are `kind:start:end` in code points, end exclusive, by kind and start, comma-joined. The base formats (see BASE) are
    always kept. Generators of high recall propose more spans, which may overlap; gradient-boosted trees judge them by format
    and context, isotonic calibration turns scores into probabilities, and a candidate of `least` or more that no base span
    overlaps is added, the likeliest first where candidates overlap. The trees are trained on TRAINING labelled candidates
    drawn by rule; the table's size is fixed.

    Whole texts are searched. NULL and empty texts have no spans; a NULL id stays NULL; repeated rows are answered alike; other
    columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["doc_id"].dataType
    sent = spark.sparkContext.broadcast(Boosted(*labelled()))
    likely = np.zeros(256, bool)
    likely[[ord(c) for c in "0123456789@"]] = True

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                data, offsets = buffer(rows["text"])
                some = np.concatenate(([0], np.cumsum(likely[data])))
                wanted = set(np.flatnonzero(some[offsets[1:]] > some[offsets[:-1]]).tolist())
                n = np.zeros((len(rows), len(BASE)), np.int64)
                digests, spans = [_NONE] * len(rows), [""] * len(rows)
                for i, words in enumerate(rows["text"]):
                    words = words.as_py() if i in wanted or _ODD.search(words.as_py() or "") else None
                    if not words:
                        continue
                    base = base_spans(words)
                    for k, _, _ in base:
                        n[i, k] += 1
                    digests[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                    spans[i] = _join(sorted(base + _added(words, base, sent.value, least)))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], *(pa.array(n[:, k]) for k in range(len(BASE))), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                                 names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return own.mapInArrow(search, f"doc_id {kind.simpleString()}, {counts}, base_sha256 string, spans string")


_NONE = hashlib.sha256(b"").hexdigest()
_ODD = re.compile(r"(?:\x20|[\])}])(?:dot|DOT)(?:\x20|[\[({])|[\[({]\x20?(?:dot|DOT)")


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _added(text: str, base: list[tuple[int, int, int]], model: Boosted, least: float) -> list[tuple[int, int, int]]:
    free = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
    if not free:
        return []
    p = model.probability(np.array([features(text, *c) for c in free]))
    out: list[tuple[int, int, int]] = []
    for score, c in sorted(zip(p.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][1], x[1])):
        if score >= least and not any(a < c[2] and c[1] < b for _, a, b in out):
            out.append(c)
    return out


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = PRECISION) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans become one. NULL texts stay NULL."""
    ship(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(Boosted(*labelled()))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch["text"].to_pylist():
                if words:
                    base = base_spans(words)
                    parts, at = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in base + _added(words, base, sent.value, least)):
                        if a >= at:
                            parts += [words[at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    words = "".join(parts) + words[at:]
                out.append(words)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])

    return own.mapInArrow(clean, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
