"""Prompts as columns, one place for each wording, and lists of passages cut until they fit a context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import BIGRAMS, LETTERS, NUMERIC

# fixed values: wordings; braces stand for what is put in
_MOST = 'Given a query "{query}", which of the following passages is the most relevant one to the query?\n\n{passages}\n\nOutput only the passage label of the most relevant passage:'
_LEAST = 'Given a query "{query}", which of the following passages is the least relevant one to the query?\n\n{passages}\n\nOutput only the passage label of the least relevant passage:'
_BOTH = 'Given a query "{query}", which of the following passages is the most relevant and which is the least relevant to the query?\n\n{passages}'
_ONE_LABEL = "\n\nReply with exactly one passage label, one of these labels: {labels}. Do not explain. Do not output any other label. If none of the passages are clearly {wanted}, still pick the {closest} one."
_ONE_NUMBER = "\n\nReply with exactly one passage number from 1 to {n}. Do not explain. Do not output 0 or any number outside 1 to {n}. If none of the passages are clearly {wanted}, still pick the {closest} one."
_TWO_LABELS = "\n\nReply with exactly two distinct passage labels, each one of these labels: {labels}. Do not explain. Strict format on one line: Best: <label>, Worst: <label>"
_TWO_NUMBERS = "\n\nReply with exactly two distinct passage numbers between 1 and {n}. Do not output 0, 'None', or any number outside the range. Pick the closest passages even if none are clearly relevant. Strict format on one line: Best: <number>, Worst: <number>"
_TWO_NUMBERS_NO_LETTERS = "\n\nReply with exactly two distinct passage numbers between 1 and {n}. Do not output letters, 0, 'None', or any number outside 1 to {n}. Pick the closest passages even if none are clearly relevant. Strict format on one line: Best: <number>, Worst: <number>"
_PAIR = 'Given a query "{query}", which of the following two passages is more relevant to the query?\n\nPassage A: "{one}"\n\nPassage B: "{two}"\n\nOutput Passage A or Passage B:'
_DUO = "Query: {query} Document0: {one} Document1: {two} Relevant:"
_POINT = {
    "qlm": "Passage: {text}\nPlease write a question based on this passage.",
    "yes_no": "Passage: {text}\nQuery: {query}\nDoes the passage answer the query? Answer 'Yes' or 'No'",
    "mono": "Query: {query} Document: {text} Relevant:",
}
_LIST_OPEN = "I will provide you with {n} passages, each indicated by number identifier []. \nRank the passages based on their relevance to query: {query}."
_LIST_READY = "Okay, please provide the passages."
_LIST_GOT = "Received passage [{i}]."
_LIST_ASK = "Search Query: {query}. \nRank the {n} passages above based on their relevance to the search query. The passages should be listed in descending order using identifiers. The most relevant passages should be listed first. The output format should be [] > [], e.g., [1] > [2]. Only response the ranking results, do not say any word or explain."
_LIST_DROPS = "Title: Content: "


def _fill(wording: str, **parts: Column) -> Column:
    """The wording with its braces filled; what is filled in is never read as a wording."""
    out, rest = [], wording
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def label_names(scheme: str, n: Column) -> Column:
    """Labels of ``n`` passages: 1.., A.. or AA..; an error where a scheme has fewer."""
    most = {NUMERIC: None, LETTERS: 23, BIGRAMS: 676}[scheme]
    code = lambda x: F.char(65 + x)
    name = {NUMERIC: lambda i: (i + 1).cast("string"), LETTERS: code, BIGRAMS: lambda i: F.concat(code(F.floor(i / 26)), code(i % 26))}[scheme]
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), name)).otherwise(F.array().cast("array<string>"))
    return every if most is None else F.when(n > most, F.raise_error(F.lit(f"more passages than {scheme} has labels")).cast("array<string>")).otherwise(every)


def window(kind: str, query: Column, passages: Column, scheme: str = LETTERS, guard: str = "plain") -> Column:
    """The prompt of a window: ``best``, ``worst`` or ``dual``, with the scheme's guardrail.

    ``guard`` is of the model: ``plain``, ``multimodal`` or ``llama``; it
    only matters to dual prompts over numbers. Null in, null out.
    """
    if kind not in ("best", "worst", "dual") or guard not in ("plain", "multimodal", "llama"):
        raise ValueError(f"no such prompt: {kind}, {guard}")
    n = F.size(passages)
    labels = label_names(scheme, n)
    shown = F.array_join(F.zip_with(labels, passages, lambda x, p: F.concat(F.lit("Passage "), x, F.lit(': "'), p, F.lit('"'))), "\n\n")
    parts = {"query": query, "passages": shown, "labels": F.array_join(labels, ", "), "n": n.cast("string")}
    if kind == "dual":
        strict = {"multimodal": _TWO_NUMBERS, "llama": _TWO_NUMBERS_NO_LETTERS}.get(guard, _TWO_LABELS) if scheme == NUMERIC else _TWO_LABELS
        return _fill(_BOTH + strict, **parts)
    best = kind == "best"
    numeric = scheme == NUMERIC
    # fixed values: words that a guardrail takes
    parts |= {"wanted": F.lit("relevant" if best else "irrelevant"), "closest": F.lit("single closest" if best else "single least relevant")}
    return _fill((_MOST if best else _LEAST) + (_ONE_NUMBER if numeric else _ONE_LABEL), **parts)


def pair(query: Column, one: Column, two: Column) -> Column:
    return _fill(_PAIR, query=query, one=one, two=two)


def duo(query: Column, one: Column, two: Column) -> Column:
    return _fill(_DUO, query=query, one=one, two=two)


def point(kind: str, query: Column, text: Column) -> Column:
    """The prompt of one passage: ``qlm``, ``yes_no`` or ``mono``."""
    return _fill(_POINT[kind], query=query, text=text)


def order_text(n: int) -> str:
    """The longest answer to a list of ``n``: its tokens are the room that the answer needs."""
    return " > ".join(f"[{i}]" for i in range(1, n + 1))


class FittedList:
    """A dialogue that shows all passages, each cut to as many words as leave it within ``limit`` tokens.

    ``count`` gives a text's tokens, ``each`` is added for a message and
    ``reply`` once. The answer's tokens are part of the limit if ``answer``.
    All passages are cut alike: from ``words`` down, by one, until it fits;
    a list that doesn't fit without any passage word is an error. No passage
    is left out. A null query or passage counts as empty.
    """

    def __init__(self, count: Callable[[str], int], limit: int, system: str = "", words: int = 300, each: int = 0, reply: int = 0, answer: bool = False):
        self.count, self.limit, self.system, self.words, self.each, self.reply, self.answer = count, limit, system, words, each, reply, answer

    def fit(self, query: str | None, passages: list[str | None]) -> tuple[int, list[str]]:
        query, n = query or "", len(passages)
        own = [(p or "").replace(_LIST_DROPS, "").split() for p in passages]
        frame = [self.system, _LIST_OPEN.format(n=n, query=query), _LIST_READY, _LIST_ASK.format(n=n, query=query)] + [_LIST_GOT.format(i=i + 1) for i in range(n)]
        room = self.limit - self.reply - self.each * (len(frame) + n) - sum(map(self.count, frame)) - (self.count(order_text(n)) if self.answer else 0)
        show = lambda i, cap: f"[{i + 1}] {' '.join(own[i][:cap])}"
        cap, took = self.words, [self.count(show(i, self.words)) for i in range(n)]
        while sum(took) > room:
            # only passages that lose a word are counted again
            cap = min(cap, max(map(len, own), default=0)) - 1
            if cap < 0:
                raise ValueError(f"{n} passages don't fit {self.limit} tokens")
            for i in range(n):
                if len(own[i]) > cap:
                    took[i] = self.count(show(i, cap))
        return cap, [show(i, cap) for i in range(n)]

    def column(self, query: Column, passages: Column) -> Column:
        """``words`` and the shown ``passages``, in Arrow batches; one row holds one list."""
        fit = self.fit

        @F.pandas_udf("words int, passages array<string>")
        def fitted(q: pd.Series, p: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([fit(a, [] if b is None else list(b)) for a, b in zip(q, p, strict=True)], columns=["words", "passages"])

        return fitted(query, passages)

    def messages(self, query: str, shown: list[str]) -> list[tuple[str, str]]:
        """``(role, text)`` of the dialogue around the passages shown."""
        n = len(shown)
        talk = [("system", self.system), ("user", _LIST_OPEN.format(n=n, query=query)), ("assistant", _LIST_READY)]
        for i, s in enumerate(shown):
            talk += [("user", s), ("assistant", _LIST_GOT.format(i=i + 1))]
        return talk + [("user", _LIST_ASK.format(n=n, query=query))]
