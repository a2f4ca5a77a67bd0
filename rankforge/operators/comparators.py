"""Comparators: what answers a comparison. Procedures never see how."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from ..functions import labels as grammar


@dataclass
class Doc:
    docid: str
    score: float
    text: str | None = None
    pos: int = 0
    hidden: float = 0.0


class Comparator:
    """Answers with positions in the window shown. Subclass and implement ``best`` at least."""

    def best(self, query: str, docs: Sequence[Doc]) -> int | None:
        raise NotImplementedError

    def worst(self, query: str, docs: Sequence[Doc]) -> int | None:
        raise NotImplementedError

    def both(self, query: str, docs: Sequence[Doc]) -> tuple[int | None, int | None]:
        b, w = self.best(query, docs), self.worst(query, docs)
        if b is not None and b == w:  # the two always differ
            w = next((k for k in reversed(range(len(docs))) if k != b), w)
        return b, w

    def prefers(self, query: str, a: Doc, b: Doc) -> bool:
        """Both orders of showing agree that ``a`` is better."""
        return self.best(query, [a, b]) == 0 and self.best(query, [b, a]) == 1

    def permute(self, query: str, docs: Sequence[Doc]) -> list[int]:
        raise NotImplementedError

    def select(self, query: str, docs: Sequence[Doc], m: int) -> list[int]:
        return self.permute(query, docs)[:m]


class ScoreComparator(Comparator):
    """Reads the answer off a hidden score; ties go to the document shown first."""

    def best(self, query, docs):
        return max(range(len(docs)), key=lambda k: (docs[k].hidden, -k))

    def worst(self, query, docs):
        return min(range(len(docs)), key=lambda k: (docs[k].hidden, -k))

    def permute(self, query, docs):
        return sorted(range(len(docs)), key=lambda k: (-docs[k].hidden, k))


class NoisyComparator(ScoreComparator):
    """Adds noise that depends on seed, query and document alone: runs repeat, seeds differ."""

    def __init__(self, seed: int, scale: float = 0.1):
        self.seed, self.scale = seed, scale

    def _shaken(self, query, docs):
        out = []
        for d in docs:
            h = hashlib.sha256(f"{self.seed}\0{query}\0{d.docid}".encode()).digest()
            out.append(Doc(d.docid, d.score, d.text, d.pos, d.hidden * (1 + self.scale * (int.from_bytes(h[:8], "big") / 2**63 - 1))))
        return out

    def best(self, query, docs):
        return super().best(query, self._shaken(query, docs))

    def worst(self, query, docs):
        return super().worst(query, self._shaken(query, docs))

    def permute(self, query, docs):
        return super().permute(query, self._shaken(query, docs))


@dataclass
class Cost:
    calls: int = 0
    retries: int = 0
    nominal_prompt: int = 0
    nominal_completion: int = 0
    retry_prompt: int = 0
    retry_completion: int = 0
    retry_seconds: float = 0.0
    reasons: dict[str, int] = field(default_factory=dict)


class TextComparator(Comparator):
    """Asks ``generate(kind, query, docs) -> (text, prompt tokens, completion tokens, seconds)`` and parses its text.

    A failed attempt moves from the nominal to the retry account. After the
    budget (three retries under ``strict``, none else) the fallback is the
    first document shown for the best, the last for the worst; with a shuffled
    order, first-stage scores decide.
    """

    def __init__(self, generate: Callable, scheme: str = grammar.NUMERIC, strict: bool = True, retries: int | None = None, by_score: bool = False):
        self.generate, self.scheme, self.strict, self.by_score = generate, scheme, strict, by_score
        self.budget = retries if retries is not None else (3 if strict else 0)
        self.cost, self.log = Cost(), []

    def _fallback(self, docs, want_best: bool) -> int:
        if self.by_score:
            pick = max if want_best else min
            return pick(range(len(docs)), key=lambda k: (docs[k].score, -docs[k].pos))
        return 0 if want_best else len(docs) - 1

    def _attempts(self, kind: str, query, docs, parse):
        """Result or None, and the last text and reason."""
        attempts, raw, reason = [], "", None
        n, c = len(docs), self.cost
        c.calls += 1
        for attempt in range(self.budget + 1):
            raw, prompt, completion, seconds = self.generate(kind, query, docs)
            got = parse(raw)
            attempts.append({"attempt_index": attempt, "raw_output": raw, "prompt_tokens": prompt, "completion_tokens": completion, "accepted": got is not None, "parse_result": None if got is None else str(got), "parse_reason": None})
            reason = None if got is not None else grammar.out_of_window(raw, self.scheme, n) or grammar.numeric_noop(raw, self.scheme, n)
            if got is not None or reason or attempt == self.budget:
                c.nominal_prompt += prompt
                c.nominal_completion += completion
                break
            c.retries += 1
            c.retry_prompt += prompt
            c.retry_completion += completion
            c.retry_seconds += seconds
        if got is None:
            reason = reason or grammar.exhausted_noop(raw, self.scheme, n) or ("strict_parse_fallback" if self.strict else "lenient_parse")
            c.reasons[reason] = c.reasons.get(reason, 0) + 1
            attempts[-1]["parse_reason"] = reason
        self.log.append({"type": kind, "raw_output": raw, "raw_attempts": attempts, "parse_status": "parsed" if got is not None else f"{reason}_noop", "parse_fallback_reason": reason})
        return got

    def _one(self, kind, query, docs):
        valid = grammar.labels(self.scheme, len(docs))
        got = self._attempts(kind, query, docs, lambda raw: grammar.parse_single(raw, self.scheme, len(docs), self.strict))
        return valid.index(got) if got is not None else self._fallback(docs, kind == "best")

    def best(self, query, docs):
        return self._one("best", query, docs)

    def worst(self, query, docs):
        return self._one("worst", query, docs)

    def both(self, query, docs):
        if len(docs) < 2:
            self.cost.calls += 1
            return 0, 0
        valid = grammar.labels(self.scheme, len(docs))

        def parse(raw):
            got = grammar.parse_dual(raw, self.scheme, len(docs), self.strict) if self.strict else grammar.parse_dual_or_default(raw, self.scheme, len(docs))
            return None if got and self.strict and got[0] == got[1] else got

        got = self._attempts("dual", query, docs, parse)
        b, w = (valid.index(x) for x in got) if got else (self._fallback(docs, True), self._fallback(docs, False))
        if b == w:
            w = next(k for k in reversed(range(len(docs))) if k != b)
        return b, w

    def permute(self, query, docs):
        return self._attempts("permute", query, docs, lambda raw: grammar.parse_permutation(raw, len(docs)))


class LikelihoodComparator(Comparator):
    """Reads ``score(query, docs) -> log-likelihood of each label`` of a best-of-window prompt: largest is best, least is worst."""

    def __init__(self, score: Callable):
        self.score = score

    def best(self, query, docs):
        found = list(self.score(query, docs))
        return max(range(len(docs)), key=lambda k: (found[k], -k))

    def worst(self, query, docs):
        found = list(self.score(query, docs))
        return min(range(len(docs)), key=lambda k: (found[k], k))

    def both(self, query, docs):
        """One reading answers both."""
        found = list(self.score(query, docs))
        return max(range(len(docs)), key=lambda k: (found[k], -k)), min(range(len(docs)), key=lambda k: (found[k], -k))


class DuoComparator(Comparator):
    """``probability(query, a, b)`` that ``a`` is better when shown first; the larger of the two orders decides."""

    def __init__(self, probability: Callable):
        self.probability = probability

    def prefers(self, query, a, b):
        return self.probability(query, a, b) > self.probability(query, b, a)

    def best(self, query, docs):
        return max(range(len(docs)), key=lambda k: (sum(self.prefers(query, docs[k], d) for d in docs if d is not docs[k]), -k))


def bounded_retry(call: Callable, transient: tuple[type[Exception], ...], attempts: int = 5, wait: Callable[[int], None] = lambda attempt: None) -> Callable:
    """``call``, tried again on transient errors up to ``attempts`` times in all; the last error is raised."""

    def tried(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except transient:
                if attempt + 1 == attempts:
                    raise
                wait(attempt)

    return tried


class ChatPairwise(Comparator):
    """Pairwise answers ``Passage A`` or ``Passage B`` of ``ask(query, a, b) -> text``, in both orders."""

    def __init__(self, ask: Callable):
        self.ask = ask

    def _first(self, query, a, b) -> bool | None:
        found = re.findall(r"passage\s*([ab])\b", self.ask(query, a, b).lower())
        return found[0] == "a" if found else None

    def prefers(self, query, a, b):
        return self._first(query, a, b) is True and self._first(query, b, a) is False


class ChatSetwise(Comparator):
    """The label in ``ask(query, docs) -> text``, letters or ``[1]`` brackets; an answer without one is the first label."""

    def __init__(self, ask: Callable, brackets: bool = False):
        self.ask, self.brackets = ask, brackets

    def best(self, query, docs):
        text = self.ask(query, docs)
        if self.brackets:
            found = [int(x) for x in re.findall(r"\[(\d+)\]", text)]
            return next((x - 1 for x in reversed(found) if 1 <= x <= len(docs)), 0)
        label = grammar.parse_single(text, grammar.LETTERS, len(docs))
        return 0 if label is None else grammar.labels(grammar.LETTERS, len(docs)).index(label)


class SelectionComparator(Comparator):
    """Selections as lines that name ``Document n``; an answer without such a line gets one corrective turn, then fails.

    ``generate(query, docs, m, before)`` is given the answer to be corrected, or None.
    ``events`` keeps a row for each selection, with what ``selection_counts`` adds.
    """

    def __init__(self, generate: Callable):
        self.generate, self.events = generate, []

    def select(self, query, docs, m):
        before, attempts = None, []
        for _ in range(2):
            text, prompt, completion, seconds = self.generate(query, docs, m, before)
            valid = any("Document" in line for line in text.splitlines())
            attempts.append((prompt, completion, seconds, valid))
            if valid:
                break
            before = text
        retried = attempts[1:]
        event = {"n": len(docs), "m": m, "status": "ok" if valid else "failed", "retry_calls": len(retried), "initial_format_valid": attempts[0][3], "format_valid": valid, "format_repair_succeeded": bool(retried) and valid}
        event |= {"prompt_tokens": sum(a[0] for a in attempts), "completion_tokens": sum(a[1] for a in attempts), "duration_seconds": sum(a[2] for a in attempts), "retry_seconds": sum(a[2] for a in retried)}
        self.events.append(event)
        if not valid:
            raise ValueError("no Document line after one corrective turn")
        named = [int(x) for line in text.splitlines() for x in re.findall(r"Document\s*\[?(\d+)", line)]
        places = [x - 1 for x in named if 1 <= x <= len(docs)]
        event["selected"] = [docs[k].docid for k in places]
        return places


class VotingComparator(Comparator):
    """Shows ``m`` orders of a window and takes the most frequent answer; ties go to the least position."""

    def __init__(self, inner: Comparator, m: int, seed: int = 929):
        self.inner, self.m, self.seed = inner, m, seed

    def _vote(self, query, docs, ask):
        votes: dict[int, int] = {}
        for k in range(self.m):
            order = list(range(len(docs)))
            random.Random(f"{self.seed}\0{query}\0{len(docs)}\0{k}").shuffle(order)
            got = ask(query, [docs[i] for i in order])
            if got is not None:
                votes[order[got]] = votes.get(order[got], 0) + 1
        return min(votes, key=lambda i: (-votes[i], i)) if votes else None

    def best(self, query, docs):
        return self._vote(query, docs, self.inner.best)

    def worst(self, query, docs):
        return self._vote(query, docs, self.inner.worst)
