"""Personal data: weak labelers, reliabilities by expectation-maximisation, a span classifier."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstream.llm.common import documents, in_arrow, staged

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# Fixed base patterns; leftmost, non-overlapping per kind, failing matches dropped.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from its later digits too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Wider candidates, whose truth the votes decide.
_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?"
        r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}",
        re.IGNORECASE,
    ),
    "ip": re.compile(
        r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9A-Za-z])"
    ),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])"
        r"[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
    ),
}
#: Gazetteers: endings of names of hosts, and leading digits of card networks.
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at be us ca".split())
_NETWORKS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
_PRIVATE = ("10.", "127.", "192.168.", "172.16.", "169.254.", "0.")
#: Words that stand near such data, in four languages.
_CONTEXT = {
    "email": re.compile(r"mail|contact|write to|kontakt|correo|courriel|@", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|server|host|adresse|direcci", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|payment|karte|tarjeta|carte", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|llam|appel", re.IGNORECASE),
}
_NUMBERING = re.compile(r"version|chapter|section|isbn|order no|\bv$", re.IGNORECASE)
NEAR = 40
#: Votes of a labeler: 0 abstains, 1 says no, 2 says yes.
LABELERS = ("strict_pattern", "gazetteer", "context", "check", "surroundings")
#: Binary features of the span classifier; the first is the bias.
FEATURES = 8
EM_ROUNDS = 50
#: Pseudo-counts of right and wrong votes per labeler, and the ridge of the classifier.
RIGHT, WRONG = 4.0, 1.0
RIDGE = 1e-4
ACCEPT = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The base pattern from one @ to the next, so long words without @ cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in code points."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _vote(says: bool | None) -> int:
    return 0 if says is None else 2 if says else 1


def judge_span(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int]:
    """Votes of the labelers (two bits each) and features (a bit each) of a candidate."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    if kind == "email":
        listed = re.split(r"[^a-z]+", span.lower())[-1] in _ENDINGS
        valid = len(span) <= 254
    elif kind == "ip":
        listed = None if span.startswith(_PRIVATE) else True
        valid = all(int(p) <= 255 for p in re.findall("[0-9]+", span)[:4] if len(p) < 5)
    elif kind == "card":
        listed = digits.startswith(_NETWORKS)
        valid = luhn(digits)
    else:
        listed = None if len(digits) > 10 else digits[:1] not in ("0", "1")
        valid = 10 <= len(digits) <= 15
    near = bool(_CONTEXT[kind].search(before) or _CONTEXT[kind].search(after[:12]))
    numbering = bool(_NUMBERING.search(before[-16:]))
    alone = (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum())
    votes = (
        _vote(True if strict else None),
        _vote(listed),
        _vote(True if near else False if numbering else None),
        _vote(valid),
        _vote(None if alone else False),
    )
    traits = (
        True,
        strict,
        bool(listed),
        near,
        valid,
        alone,
        numbering,
        any(c in span for c in "([{"),
    )
    return (
        sum(v << (2 * i) for i, v in enumerate(votes)),
        sum(int(t) << i for i, t in enumerate(traits)),
    )


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, votes, features) of base spans and of wider ones that overlap none."""
    found = [(kind, s, e, *judge_span(text, kind, s, e, True)) for s, kind, e in base]
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    ends = list(accumulate((e for _, e in taken), max))
    for kind, pattern in _LOOSE.items():
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                found.append((kind, m.start(), m.end(), *judge_span(text, kind, *m.span(), False)))
    return found


def _has_candidates(text: str) -> bool:
    return "@" in text or re.search(r"[0-9]|\bat\b", text, re.IGNORECASE) is not None


_SPAN = pa.struct(
    [
        ("kind", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("votes", pa.int32()),
        ("features", pa.int32()),
        ("base", pa.bool_()),
    ]
)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column(1).to_pylist():
            if not text or not _has_candidates(text):
                spans.append([])
                continue
            base = base_spans(text)
            rows = candidates(text, base)
            spans.append([(*row, i < len(base)) for i, row in enumerate(rows)])
        names = [f.name for f in _SPAN]
        spans = [[dict(zip(names, row)) for row in rows] for rows in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(_SPAN))],
            names=[batch.schema.names[0], "candidates"],
        )


def span_candidates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and the candidate spans with their votes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "kind: string, start: int, end: int, votes: int, features: int, base: boolean"
    return in_arrow(
        docs.select("doc_id", "text"), _found, f"doc_id {kind}, candidates array<struct<{span}>>"
    )


def reliabilities(
    votes: np.ndarray, counts: np.ndarray, certain: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that each vote pattern is personal data, and P(vote | truth) per labeler.

    Expectation-maximisation over the patterns, weighted by how often each occurs. Only votes
    given count: that a labeler abstains says nothing. Labelers are taken to be right rather
    than wrong by a few pseudo-counts, and candidates to be as likely true as not, but for the
    ``certain`` patterns, which are true.
    """
    told = np.stack([(votes >> (2 * i)) & 3 for i in range(len(LABELERS))], axis=1)
    start = ((told == 2).sum(axis=1) + 1) / ((told > 0).sum(axis=1) + 2)
    if certain is not None:
        start = np.where(certain, 1.0, start)
    truth = np.stack([1 - start, start], axis=1)
    says = np.ones((len(LABELERS), 2, 3))
    for _ in range(EM_ROUNDS):
        weight = truth * counts[:, None]
        for labeler in range(len(LABELERS)):
            for vote in (1, 2):
                seen = weight[told[:, labeler] == vote].sum(axis=0)
                says[labeler, :, vote] = seen + np.where(np.arange(2) == vote - 1, RIGHT, WRONG)
        says[:, :, 1:] /= says[:, :, 1:].sum(axis=2, keepdims=True)
        logs = sum(np.log(says[i][:, told[:, i]]).T for i in range(len(LABELERS)))
        logs -= logs.max(axis=1, keepdims=True)
        truth = np.exp(logs)
        truth /= truth.sum(axis=1, keepdims=True)
        if certain is not None:
            truth[certain] = 0.0, 1.0
    return truth[:, 1], says


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the soft labels, by Newton steps with a small ridge.

    Spans of the strict patterns, far more as a rule, weigh as much as all others together.
    """
    rows = np.stack([(features >> i) & 1 for i in range(FEATURES)], axis=1).astype(float)
    strict = rows[:, 1] == 1
    share = counts.astype(float)
    for part in (strict, ~strict):
        share[part] /= max(share[part].sum(), 1)
    share /= max(share.sum(), 1)
    weights = np.zeros(FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (share * (p - target)) + RIDGE * weights
        curve = (rows * (share * p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        weights -= step / max(1.0, np.abs(step).max() / 2)
    return weights


def learn_spans(found: DataFrame) -> dict[str, np.ndarray]:
    """Classifier weights per kind, learned from all candidates of the corpus.

    Only counts per (kind, votes, features) reach the driver: votes and features have a fixed
    number of bits, so there is a fixed number of them.
    """
    spans = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    table: dict[str, list[tuple[int, int, int]]] = {kind: [] for kind in KINDS}
    for r in spans.groupBy("kind", "votes", "features").count().collect():
        table[r["kind"]].append((r["votes"], r["features"], r["count"]))
    weights = {}
    for kind, rows in table.items():
        if rows:
            votes, features, counts = (np.array(c) for c in zip(*sorted(rows)))
            truth, _ = reliabilities(votes, counts, votes & 3 == 2)
            weights[kind] = fit_classifier(features, truth, counts)
    return weights


def _accepted(weights: dict[str, np.ndarray], accept: float) -> Callable:
    need = math.log(accept / (1 - accept))
    sure = {
        (kind, features): float(w @ [(features >> i) & 1 for i in range(FEATURES)]) >= need
        for kind, w in weights.items()
        for features in range(1 << FEATURES)
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for spans in batch.column(1).to_pylist():
                chosen = [s for s in spans or [] if s["base"] or sure.get((s["kind"], s["features"]))]
                chosen.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
                kept.append([{n: s[n] for n in ("kind", "start", "end", "base")} for s in chosen])
            fields = [f for f in _SPAN if f.name not in ("votes", "features")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.list_(pa.struct(fields)))],
                names=[batch.schema.names[0], "spans"],
            )

    return run


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (kind, start, end, base) in text order.

    Base patterns always stay. Wider patterns give further candidates; pattern, gazetteer,
    context, check and surroundings vote on each, expectation-maximisation over all candidates
    of the corpus estimates how far each vote can be trusted, and a classifier per kind, trained
    on the resulting probabilities, accepts a candidate at ``accept`` or more. Positions are code
    points of the whole text, end exclusive. A null or empty text has no spans; equal texts have
    equal spans; repeated rows each give a row; an empty table gives an empty table. Other input
    columns are left out.
    """
    found = staged(span_candidates(docs), "span-candidates")
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "kind: string, start: int, end: int, base: boolean"
    return in_arrow(
        found, _accepted(learn_spans(found), accept), f"doc_id {kind}, spans array<struct<{span}>>"
    )


def op5_weak_supervision(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["base"])

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
