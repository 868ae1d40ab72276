"""License notices in texts by patience alignment with templates.

Words that stand exactly once in both a stretch of text and a template are anchors; the longest increasing run of
them is kept, and the gaps between kept anchors are aligned in the same way. Coverage is the share of the template's
words that were aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches

#: Notices and opening clauses of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-3.0-notice": "Licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
}
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
#: words inserted on either side that are allowed for, as a share of the template
SLACK = 0.25
FOUND = "array<struct<license:string,coverage:double,start:int,end:int>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(_low(text))


def _low(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers rise."""
    tops: list[int] = []
    places: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(places[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            places.append(n)
        else:
            tops[k], places[k] = b, n
    run, n = [], places[-1] if places else -1
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: n for n, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _rising([(n, at[w]) for n, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False) if u > x + 1 and v > y + 1]
    return sorted(out)


def find(text: str, templates: Mapping[str, Sequence[str]], least: float, slack_share: float = SLACK) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, first word, end word)`` of every stretch that covers ``least`` of a template or more.

    A text whose words cannot reach that share is left at once. A stretch that does must hold one of the template's
    rarest words, taken until they fill one place more than may be missing, so only surroundings of those are aligned:
    the template's length and ``slack_share`` of it on either side. A notice that more foreign words interrupt is not found.
    Of overlapping stretches the one with most aligned words counts.
    """
    words = words_of(text)
    counts = Counter(words)
    out: list[tuple[str, float, int, int, int]] = []
    places: dict[str, list[int]] | None = None
    for name, template in templates.items():
        need = max(1, math.ceil(least * len(template) - 1e-9))
        if sum(w in counts for w in template) < need:
            continue
        if places is None:
            known, places = set().union(*templates.values()), {}
            for n, w in enumerate(words):
                if w in known:
                    places.setdefault(w, []).append(n)
        spare, rare, filled = len(template) - need + 1, [], 0
        for w, n in sorted(Counter(template).items(), key=lambda x: (counts[x[0]], x[0])):
            if filled < spare:
                rare.append(w)
                filled += n
        slack, end = max(2, int(slack_share * len(template))), 0
        for n in sorted(n for w in rare for n in places.get(w, ())):
            if n < end:
                continue
            best: list[tuple[int, int]] = []
            lo = 0
            for at in (k for k, w in enumerate(template) if w == words[n]):
                first = max(end, n - at - slack)
                pairs = align(words[first : n + len(template) - at + slack], template)
                if len(pairs) > len(best):
                    best, lo = pairs, first
            if len(best) >= need:
                end = lo + best[-1][0] + 1
                out.append((name, len(best) / len(template), lo + best[0][0], end, len(best)))
    kept: list[tuple[str, float, int, int, int]] = []
    starts: list[int] = []
    for one in sorted(out, key=lambda x: (-x[4], -x[1], x[0], x[2])):
        at = bisect_left(starts, one[2])
        if (at == 0 or kept[at - 1][3] <= one[2]) and (at == len(kept) or one[3] <= kept[at][2]):
            starts.insert(at, one[2])
            kept.insert(at, one)
    return [k[:4] for k in kept]


def with_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    least: float = 0.8,
    text_col: str = "text",
    slack_share: float = SLACK,
) -> DataFrame:
    """Every row of ``docs`` with ``licenses``: ``(license, coverage, start, end)``, places in words, by start.

    Null and empty texts have none; a template without words is never found. Repeated notices are all reported. An
    empty table stays empty; a column of ``docs`` named ``licenses`` is replaced. Nothing is exchanged. Foreign words between
    the words of a notice may make up ``slack_share`` of the template on either side of a rare word, and no more.
    """
    bound_batches(docs.sparkSession)
    listed = {name: tuple(words_of(t)) for name, t in templates.items() if words_of(t)}

    @F.pandas_udf(FOUND)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([find(t or "", listed, least, slack_share) for t in batch], dtype=object)

    return docs.drop("licenses").withColumn("licenses", scan(F.col(text_col)))
