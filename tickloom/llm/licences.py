"""License scan of paragraphs: sparse logistic regression over word n-grams, confirmed against templates.

Training paragraphs are variants of the templates (words dropped, corpus words around them) against background
paragraphs of the corpus; notices that grant or reserve rights without naming a family make the unknown
class. A third of them is held out to fit a temperature, so that probabilities are calibrated. Every
line of every text is scored, long ones in overlapping windows, and every block of lines up to a blank one in windows
over the line ends, since notices are wrapped. Where the background class falls below ``GATE``, the families
are compared with their templates: the share of a template's words met in order must reach ``CONFIRM``, for
other families than the likeliest also among the words that few families use. A match within another family's
words does not count. Three rules tell neighbours apart: every word that a notice has and a similar notice of another family lacks must be
met; a title must stand whole, without words between its own; and no negation may stand before the name.
A likeliest family that stays below counts as unknown from ``LIKE`` on and as background under it.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 14
WINDOW, STRIDE = 48, 24
NARROW, STEP = 24, 4  #: over line ends, besides WINDOW and STRIDE
CONFIRM, LIKE = 0.8, 0.5
PART = 50_000  #: words whose class sums are held at once
GATE, NONE = 0.9, 0.5  #: background probabilities below which templates are compared, and below which a notice may stay unconfirmed
BACKGROUND, UNKNOWN = "none", "unknown"
DROP = b".,;:()\"'`*#/"

#: Short notices by which texts name their licence.
TEMPLATES = {
    UNKNOWN: ["all rights reserved", "this software is proprietary and confidential", "use is subject to the licence agreement",
              "released under a custom license", "licensed under the terms of the accompanying license file",
              "permission is granted under the terms of your agreement with the owner"],
    "mit": ["released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "spdx-license-identifier mit"],
    "apache-2.0": ["licensed under the apache license version 2.0", "released under the apache license version 2.0",
                   "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0", "spdx-license-identifier apache-2.0"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3",
                "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license "
                "as published by the free software foundation either version 3 of the license", "released under the gnu general public license version 3 or later",
                "licensed under the gpl version 3", "spdx-license-identifier gpl-3.0-or-later"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2",
                "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license "
                "as published by the free software foundation either version 2 of the license", "released under the gnu general public license version 2 or later",
                "licensed under the gpl version 2", "spdx-license-identifier gpl-2.0-only"],
    "agpl-3.0": ["this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license",
                 "released under the gnu affero general public license version 3 or later",
                 "this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license "
                 "as published by the free software foundation either version 3 of the license", "licensed under the agpl version 3",
                 "spdx-license-identifier agpl-3.0-or-later"],
    "lgpl": ["licensed under the gnu lesser general public license",
             "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license "
             "as published by the free software foundation", "released under the lgpl version 2.1", "spdx-license-identifier lgpl-2.1-or-later"],
    "bsd": ["released under the bsd license", "licensed under the 3-clause bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted", "spdx-license-identifier bsd-3-clause"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license 2.0", "spdx-license-identifier mpl-2.0"],
    "epl-2.0": ["licensed under the eclipse public license version 2.0", "released under the eclipse public license version 2.0",
                "made available under the terms of the eclipse public license 2.0", "spdx-license-identifier epl-2.0"],
    "isc": ["released under the isc license", "licensed under the isc license",
            "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier isc"],
    "zlib": ["released under the zlib license", "licensed under the zlib license",
             "this software is provided as-is without any express or implied warranty in no event will the authors be held liable", "spdx-license-identifier zlib"],
    "bsl-1.0": ["distributed under the boost software license version 1.0", "licensed under the boost software license version 1.0",
                "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license", "spdx-license-identifier bsl-1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "licensed under the unlicense",
                  "spdx-license-identifier unlicense"],
    "cc0-1.0": ["licensed under cc0 1.0", "released under cc0 1.0 universal", "released under the creative commons cc0 1.0 universal public domain dedication",
                "spdx-license-identifier cc0-1.0"],
    "cc-by-nd": ["licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
}
CLASSES = [BACKGROUND, *TEMPLATES]
#: Titles, whose words follow each other.
TITLES = ["gnu general public license", "gnu lesser general public license", "gnu affero general public license", "mozilla public license",
          "eclipse public license", "boost software license", "apache license", "mit license", "isc license", "zlib license", "bsd license",
          "creative commons attribution"]
NEGATIONS = {b"not", b"never", b"isnt", b"arent", b"wasnt", b"neither", b"nor", b"cannot"}
NEAR = 0.5  #: share of a notice's words in another family's from which the words they do not share are required


def words(paragraph: bytes) -> list[bytes]:
    return paragraph.lower().translate(None, DROP).split()


def _lesser(tokens: list[bytes]) -> list[bytes]:
    """The word after "lesser" is another word: the lesser general licence is not the general one."""
    return [b"lesser-" + t if before == b"lesser" else t for before, t in zip([b"", *tokens], tokens)]


_WORDS = {family: [words(t.encode()) for t in notices] for family, notices in TEMPLATES.items()}
_USED = Counter(w for notices in _WORDS.values() for w in set().union(*map(_lesser, notices)))
_NAMES = {family: [{w for w in _lesser(notice) if _USED[w] <= 3} for notice in notices] for family, notices in _WORDS.items()}


def _required(family: str, notice: list[bytes]) -> set[bytes]:
    """Words of ``notice`` that a similar notice of another family lacks."""
    own, out = set(_lesser(notice)), set()
    for other, notices in _WORDS.items():
        for theirs in (set(_lesser(n)) for n in notices if other != family):
            if len(own & theirs) >= NEAR * len(own):
                out |= own - theirs
    return out


def _titles(notice: list[bytes]) -> list[range]:
    """Places of the titles in ``notice``."""
    titles = [_lesser(words(t.encode())) for t in TITLES]
    return [range(i, i + len(t)) for t in titles for i in range(len(notice)) if notice[i:i + len(t)] == t]


_REQUIRED = {family: [_required(family, n) for n in notices] for family, notices in _WORDS.items()}
_TITLES = {family: [_titles(_lesser(n)) for n in notices] for family, notices in _WORDS.items()}


def _grams(tokens: list[bytes]) -> np.ndarray:
    """(3, words) slots of the one, two and three words that end at each place."""
    h = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)).astype(np.uint64)
    out = np.empty((3, len(h)), np.int64)
    run = h
    for n in range(3):
        if n:
            run = run * np.uint64(1_000_003)
            run[n:] += h[:-n] if len(h) > n else h[:0]
        out[n] = ((run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    return out


def _features(tokens: list[bytes]) -> np.ndarray:
    g = _grams(tokens)
    return np.concatenate([g[n, n:] for n in range(3)])


def labelled(loose: list[bytes], variants: int, rng: random.Random) -> list[tuple[list[bytes], int]]:
    """(words, class) of ``variants`` paragraphs for every notice: words dropped, ``loose`` words around them."""
    rows = []
    for family, notices in _WORDS.items():
        for notice in notices:
            for _ in range(variants):
                kept = [w for w in notice if rng.random() > 0.05] or notice
                at = rng.randrange(len(loose))
                before, after = rng.randrange(0, 9) * (rng.random() < 0.5), rng.randrange(0, 9) * (rng.random() < 0.5)
                rows.append((loose[at:at + before] + kept + loose[at + before:at + before + after], CLASSES.index(family)))
    return rows


def train(background: list[list[bytes]], *, variants: int = 40, rounds: int = 120, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, temperature). ``background`` paragraphs that a template confirms are left out."""
    rng = random.Random(seed)
    loose = [w for p in background for w in p] or [b"the"]
    rows = [(p, 0) for p in background if p and not any(similarity(p, f, CONFIRM) >= CONFIRM for f in TEMPLATES)] + labelled(loose, variants, rng)
    rng.shuffle(rows)
    held = len(rows) // 3
    sets = [[_features(p) for p, _ in part] for part in (rows[held:], rows[:held])]
    truth = [np.array([c for _, c in part], int) for part in (rows[held:], rows[:held])]
    bias = np.zeros(len(CLASSES), np.float32)
    size = np.array([len(x) for x in sets[0]])
    owner, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    slots, at = np.unique(np.concatenate(sets[0]), return_inverse=True)  # the others keep weight 0
    order = np.argsort(at, kind="stable")
    owners, begins = owner[order], np.searchsorted(at[order], np.arange(len(slots)))
    scale = np.float32(1) / size.astype(np.float32)
    w = np.zeros((len(slots), len(CLASSES)), np.float32)
    moment = np.full_like(w, 1e-6)
    for _ in range(rounds):  # adaptive gradient on the mean loss
        error = _softmax(np.add.reduceat(w[at], starts) + bias)
        error[np.arange(len(size)), truth[0]] -= 1
        g = np.add.reduceat((error * scale[:, None])[owners], begins) + 1e-4 * w
        moment += g * g
        w -= 0.3 * g / np.sqrt(moment)
        bias -= 0.05 * error.mean(0) * len(CLASSES)
    weights = np.zeros((SLOTS, len(CLASSES)), np.float32)
    weights[slots] = w
    z = np.stack([weights[x].sum(0) for x in sets[1]]) + bias if held else np.zeros((0, len(CLASSES)))
    grid = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]
    loss = [-np.log(_softmax(z / t)[np.arange(len(z)), truth[1]] + 1e-9).mean() if held else 0.0 for t in grid]
    return weights, bias, grid[int(np.argmin(loss))]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def similarity(tokens: list[bytes], family: str, least: float = 0.0) -> float:
    """Largest share of a template's words that stand in ``tokens`` in its order; shares below ``least`` may come out as 0."""
    best, here = 0.0, set(tokens)
    for notice in _WORDS[family]:
        if sum(w in here for w in notice) < max(least, best) * len(notice):
            continue
        row = [0] * (len(tokens) + 1)
        for w in notice:
            last = 0
            for j, t in enumerate(tokens, 1):
                keep = row[j]
                row[j] = last + 1 if w == t else max(row[j], row[j - 1])
                last = keep
        best = max(best, row[-1] / len(notice))
    return best


def _match(notice: list[bytes], tokens: list[bytes]) -> list[tuple[int, int]]:
    """(place in ``notice``, place in ``tokens``) of the most words that stand in both in order, as close together as they come."""
    table = [[0] * (len(tokens) + 1)]
    for w in notice:
        above, row = table[-1], [0]
        for j, t in enumerate(tokens):
            row.append(above[j] + 1 if w == t else max(above[j + 1], row[j]))
        table.append(row)
    i, j, places = len(notice), table[-1].index(table[-1][-1]), []
    while i and j and table[i][j]:
        if notice[i - 1] == tokens[j - 1]:
            i, j = i - 1, j - 1
            places.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return places[::-1]


def _holds(tokens: list[bytes], found: list[tuple[int, int]], required: set[bytes], titles: list[range]) -> bool:
    """Whether a match has the words that make it this family's, its titles whole, and no negation before its last required word."""
    at, places = dict(found), {j for _, j in found}
    if not required <= {tokens[j] for j in places}:
        return False
    if any(i not in at or (i > title[0] and at[i] != at[i - 1] + 1) for title in titles for i in title):
        return False
    first = found[0][1]
    last = max((j for j in places if tokens[j] in required), default=first)
    return not any(tokens[j] in NEGATIONS for j in range(max(0, first - 3), last) if j not in places)


def _confirmed(tokens: list[bytes], likeliest: str) -> list[tuple[str, float, list[int]]]:
    """(family, similarity, places) of the families that the words confirm."""
    tokens = _lesser(tokens)
    here, found = set(tokens), []
    for family, notices in _WORDS.items():
        best = (0.0, [])
        for notice, names, required, titles in zip(map(_lesser, notices), _NAMES[family], _REQUIRED[family], _TITLES[family]):
            if not required <= here or sum(w in here for w in notice) < CONFIRM * len(notice):
                continue
            pairs = _match(notice, tokens)
            if not pairs or not _holds(tokens, pairs, required, titles):
                continue
            places = [j for _, j in pairs]
            met = {tokens[p] for p in places}
            if len(places) >= CONFIRM * len(notice) and (family == likeliest or len(names & met) >= CONFIRM * len(names)):
                best = max(best, (len(places) / len(notice), places), key=lambda b: (b[0], len(b[1])))
        if best[1]:
            found.append((family, *best))
    met = {family: {tokens[p] for p in places} for family, _, places in found}
    return [f for f in found if not any(met[f[0]] < met[g] for g in met)]


def _windows(size: int, window: int, stride: int):
    return ((s, min(s + window, size)) for s in range(0, max(1, size - window + stride), stride))


def scan_texts(texts: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float) -> list[tuple]:
    """(text number, line, family, probability, similarity, confirmed) of every notice; the line is the one it begins on."""
    tokens, line_of, spans = [], [], []
    for number, text in enumerate(texts):
        begin, lines = len(tokens), 0
        for line, raw in enumerate([*text.encode("utf-8", "surrogatepass").split(b"\n"), b""]):
            own = words(raw)
            at = len(tokens)
            if own:
                spans.extend((number, at + s, at + e) for s, e in _windows(len(own), WINDOW, STRIDE))
                tokens += own
                line_of += [line] * len(own)
                lines += 1
            if not raw.strip():
                if lines > 1:
                    spans.extend((number, begin + s, begin + e) for size in ((WINDOW, STRIDE), (NARROW, STEP))
                                 for s, e in _windows(at - begin, *size) if line_of[begin + s] != line_of[begin + e - 1])
                begin, lines = at, 0
    if not spans:
        return []
    grams = _grams(tokens)
    spans.sort(key=lambda s: s[1])
    at = np.array([s[1:] for s in spans])
    z = np.tile(bias, (len(spans), 1)).astype(np.float64)
    for low in range(0, len(tokens), PART):  # a part's running sums, however long the texts are
        some = slice(*np.searchsorted(at[:, 0], [low, low + PART]))
        begin, end = at[some, 0] - low, at[some, 1] - low
        for n in range(3):
            part = weights[grams[n, low:low + PART + WINDOW]]
            run = np.zeros((len(part) + 1, len(CLASSES)))
            np.cumsum(part, 0, out=run[1:])
            z[some] += run[end] - run[np.minimum(begin + n, end)]
    p = _softmax(z / temperature)
    sure, weak = [], []
    for i in np.flatnonzero(p[:, 0] < GATE):
        number, s, e = spans[i]
        likeliest = CLASSES[1 + int(p[i, 1:].argmax())]
        some = _confirmed(tokens[s:e], likeliest)
        sure.extend((number, line_of[s + places[0]], line_of[s + places[-1]], family, float(p[i, CLASSES.index(family)]), like) for family, like, places in some)
        if not some and p[i, 0] < NONE and (like := similarity(tokens[s:e], likeliest, LIKE)) >= LIKE:  # repeated words can outweigh the background class without being a notice
            weak.append((number, line_of[s], line_of[e - 1], UNKNOWN, float(p[i, 1:].max()), like))
    taken: dict = {}
    owner: dict = {}
    best: dict = {}
    for known in (True, False, None):  # unknown notices do not count on the lines of known ones, nor weak ones on those of either
        some = [f for f in sure if (f[3] != UNKNOWN) == known] if known is not None else weak
        for number, first, last, family, sureness, like in sorted(some, key=lambda f: (f[2] - f[1] if known is None else 0, -f[5], f[1])):
            lines = range(first, last + 1)
            if not known and any(taken.get((number, line), known) is not known for line in lines):
                continue
            if any(owner.get((number, family, line), first) != first for line in lines):  # a window that cuts the notice
                continue
            found = (sureness, like, known is not None)
            best[number, first, family] = max(best.get((number, first, family), found), found)
            for line in lines:
                taken.setdefault((number, line), known)
                owner[number, family, line] = first
    return [(n, line, family, *f) for (n, line, family), f in best.items()]


def scan_licences(docs: DataFrame, *, id: str = "doc_id", text: str = "text", background_docs: int = 200) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed): one row per line on which a notice of a family begins.

    ``paragraph`` is that line, counted from 0; a notice may run over the line ends up to the next blank line. The background is the text of ``background_docs`` documents, of at most 20,000
    characters, chosen by a hash of the text, of which the first 20 lines a document on average and the first ``WINDOW`` words of a line
    are used: the bound of the fit's sample. Only hashes are compared over all documents; the chosen texts alone reach the driver. Null and empty texts have no paragraphs. Null ids and repeated rows are scanned like
    others; an empty table gives an empty result. Every confirmed family has its
    row; unknown ones give way to known families on the same lines, and of several windows the higher probability wins.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(text).alias("t")).filter("length(t) <= 20000").withColumn("h", F.xxhash64("t"))
    least = [r["h"] for r in texts.select("h").orderBy("h").limit(background_docs).collect()]
    some = sorted(texts.filter(F.col("h") <= least[-1]).distinct().collect(), key=lambda r: (r["h"], r["t"])) if least else []
    background = [p for r in some for line in r["t"].encode("utf-8", "surrogatepass").split(b"\n") if (p := words(line)[:WINDOW])]
    fitted = spark.sparkContext.broadcast(train(background[:20 * background_docs]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 64):
                found = scan_texts(texts[at:at + 64], *fitted.value)
                cols = list(zip(*found)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([at + n for n in cols[0]], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
                    pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.bool_())],
                    ["id", "paragraph", "family", "probability", "similarity", "confirmed"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, paragraph int, family string, probability double, similarity double, confirmed boolean").withColumnRenamed("id", id)
