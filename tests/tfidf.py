"""Two-document TF-IDF similarity straight from its definition (smooth idf, l2 norm)."""

from __future__ import annotations

import math
import re
from collections import Counter

from hirelens.functions import fixed

_STOP = frozenset(fixed.ENGLISH_STOP_WORDS)


def _counts(text: str) -> Counter:
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in _STOP]
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def similarity(a: str, b: str) -> float:
    docs = _counts(a), _counts(b)
    weight = {t: math.log(3 / (1 + sum(t in d for d in docs))) + 1 for t in docs[0] | docs[1]}
    va, vb = ({t: n * weight[t] for t, n in d.items()} for d in docs)
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in (va, vb)]
    if not all(norms):
        return 0.0
    return round(100 * sum(x * vb.get(t, 0) for t, x in va.items()) / (norms[0] * norms[1]), 2)
