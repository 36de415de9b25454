"""Small documents for the tests of the training-data operators."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might use inside or give out themselves.
CLASHING = (
    "doc string, n string, key string, token string, score string, rejected string, predicted string, "
    "lang_pred string, n_lines string, component string, id string, start string, item string, tokens string"
)


def documents(spark, rows, clashing=False):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = []
    for i, text, *more in rows:
        lang, source = (*more, None, None)[:2]
        full.append((i, text, lang, source, len(text or "")))
    if not clashing:
        return spark.createDataFrame(full, DOCUMENTS)
    n = CLASHING.count(" string")
    return spark.createDataFrame([(*r, *("x",) * n) for r in full], f"{DOCUMENTS}, {CLASHING}")


def prose(seed, n, syllables="ka lo mi ten dar us re vi so pel an to", least=2):
    """`n` invented words."""
    rng = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(least, least + 2))) for _ in range(n))


def rows_by_id(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}


def groups(ids, links):
    """The smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
