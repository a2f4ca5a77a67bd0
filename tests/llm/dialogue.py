"""The dialogue of groups and one reader of all names, held in one process without Spark."""

import numpy as np
import pyarrow as pa

from rankforge.llm._names import Texts


def hold(groups, asks, judges, finish):
    """Rows that ``finish`` gives for groups of (id, text)."""
    texts = [Texts(pa.table({"doc_id": pa.array([i for i, _ in g], pa.int64()), "text": pa.array([t for _, t in g], pa.string())})) for g in groups]
    states, replies = [b""] * len(groups), [None] * len(groups)
    for step, judge in zip(asks, judges, strict=True):
        said = [step(t, s, r) for t, s, r in zip(texts, states, replies, strict=True)]
        states, found = [state for _, state in said], [ask for ask, _ in said]
        names = np.concatenate([a.names for a in found])
        heard = judge(names, [np.concatenate(c) for c in zip(*(a.columns for a in found if len(a.names)), strict=True)]) if len(names) else np.zeros(0, np.uint64)
        replies = np.split(heard, np.cumsum([len(a.names) for a in found])[:-1])
    return [row for t, s, r in zip(texts, states, replies, strict=True) for row in finish(t, s, r).to_pylist()]
