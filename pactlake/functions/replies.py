"""Objects in a model's reply, and the part of a passage that bears on a question: small helpers on single texts, run in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

# Keys under which services put a reply.
WRAPPERS = ("response", "message", "content", "result", "output", "data")
#: How far a reply may be wrapped in itself.
DEPTH = 16

_DECODER = json.JSONDecoder()


def find_object(text: str | None, wanted: frozenset[str], depth: int = 0) -> dict | None:
    """The first object with all wanted keys in a reply: the reply itself, what its pieces (a JSON object a line, each with a part of the answer) make up, what a wrapper holds, or an object within prose. Brackets within strings do not count."""
    text = (text or "").strip()
    if not text or depth > DEPTH:
        return None
    pieces = [p for line in text.splitlines() if (p := _piece(line.strip())) is not None]
    if pieces:
        return find_object("".join(pieces), wanted, depth + 1) or (_look(_load(text), wanted, depth) if len(pieces) == 1 else None)
    whole = _load(text)
    if isinstance(whole, (dict, list)):
        return _look(whole, wanted, depth)
    return next((o for value in within(text) if (o := _look(value, wanted, depth)) is not None), None)


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _piece(line: str) -> str | None:
    """What a line of a stream holds of the answer; None for another line."""
    value = _load(line) if line.startswith("{") else None
    if not isinstance(value, dict):
        return None
    held = value.get("response") if "response" in value else value["message"].get("content", "") if isinstance(value.get("message"), dict) else None
    return held if isinstance(held, str) else None


def within(text: str) -> Iterator[dict]:
    """All objects in a text, an outer one before those in it. A bracket that opens no object is passed over."""
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            yield value
        except (ValueError, RecursionError):
            pass
        at = text.find("{", at + 1)


def _look(value: object, wanted: frozenset[str], depth: int) -> dict | None:
    if depth > DEPTH:
        return None
    if isinstance(value, str):
        return find_object(value, wanted, depth + 1)
    if isinstance(value, dict):
        if wanted <= value.keys():
            return value
        inner = [value[k] for k in WRAPPERS if k in value] + [v for k, v in value.items() if k not in WRAPPERS]
    else:
        inner = value if isinstance(value, list) else []
    return next((o for v in inner if isinstance(v, (str, dict, list)) and (o := _look(v, wanted, depth + 1)) is not None), None)


def upper_each(text: str) -> str:
    """A text in capitals, character by character as SQL has it: one of one, where Python's upper() writes `ß` as two; what has no single capital stays."""
    return "".join(u if len(u := c.upper()) == 1 else "\u1e9e" if c == "ß" else u if len(u := c.title()) == 1 else c for c in text)


# --- focus ---

_SENTENCE, _WORD = re.compile(r"(?<=[.;:])[ \t\n\x0b\f\r]+"), re.compile(r"[ \t\n\x0b\f\r]+")
_TERM, _BARE = re.compile(r"[a-z0-9%.]{3,}"), re.compile(r"[a-z0-9](?:[a-z0-9%.]*[a-z0-9])?")


def focus_of(text: str, terms: frozenset[str], limit: int, whole: bool = False) -> str:
    """See retrieval.focus(). One pass over sentences or words, with two ends that only move on."""
    if len(text) <= limit:
        return text
    parts = _SENTENCE.split(text)
    scores = [len({w.strip("%.") for w in _TERM.findall(p.lower())} & terms) for p in parts]
    if whole:
        return _best_run(parts, scores, limit) if min(map(len, parts)) <= limit else text
    if len(parts) > 1 and len(parts[scores.index(max(scores))]) <= limit:
        return _best_run(parts, scores, limit)
    return _best_words(text, terms, limit)


def _best_run(parts: list[str], scores: list[int], limit: int) -> str:
    ends, sums = [0, *accumulate(len(p) + 1 for p in parts)], [0, *accumulate(scores)]
    best, hi = (-1, 0, 0, 0), 0
    for lo in range(len(parts)):
        hi = max(hi, lo)
        while hi < len(parts) and ends[hi + 1] <= ends[lo] + limit + 1:
            hi += 1
        if hi > lo:
            best = max(best, (sums[hi] - sums[lo], ends[hi] - ends[lo], -lo, hi))
    lo, hi = -best[2], best[3]
    return ("… " if lo else "") + " ".join(parts[lo:hi]) + (" …" if hi < len(parts) else "")


def _best_words(text: str, terms: frozenset[str], limit: int) -> str:
    words = _WORD.split(text)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    found = ((k, _BARE.search(w.lower())) for k, w in enumerate(words))
    hits = [(at[k], m[0]) for k, m in found if m and m[0] in terms]
    total: dict[str, int] = {}
    for _, t in hits:
        total[t] = total.get(t, 0) + 1
    here = dict.fromkeys(total, 0)
    half, lo, hi, score, best = limit // 2, 0, 0, 0.0, (-1.0, 0)
    for place, _ in hits:
        while hi < len(hits) and hits[hi][0] <= place + half:
            here[hits[hi][1]] += 1
            score += 1 / total[hits[hi][1]] if here[hits[hi][1]] == 1 else 0
            hi += 1
        while hits[lo][0] < place - half:
            here[hits[lo][1]] -= 1
            score -= 1 / total[hits[lo][1]] if here[hits[lo][1]] == 0 else 0
            lo += 1
        best = max(best, (round(score, 9), -place))
    start = max(0, min(-best[1] - half, len(text) - limit))
    kept = [w for k, w in enumerate(words) if at[k] >= start and at[k] + len(w) <= start + limit]
    return ("… " if start else "") + " ".join(kept) + (" …" if start + limit < len(text) else "")
