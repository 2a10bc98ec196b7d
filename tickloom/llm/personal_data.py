"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. Wider
patterns propose further candidates. Five labelers vote (1, -1, or 0 for no opinion) on every candidate:
the strict pattern, a gazetteer, context words before it, its shape, and its borders. The corpus gives the
number of candidates of each kind and vote pattern, at most kinds * 3**5 rows; on that table expectation
maximisation estimates how reliable each labeler is, and a logistic classifier of kind and votes is
trained on the resulting probabilities. A proposed span is added where the classifier is sure and no base
span overlaps it.

The patterns use possessive runs, and start a run only at its border or where the last match ended, so that
they find what the plain patterns find in time linear in the text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

KINDS = ["email", "ip", "card", "phone", "person"]
LABELERS = ["pattern", "gazetteer", "context", "shape", "border"]
VOTES = (-1, 0, 1)

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",  # shorter runs of digits fail the check anyway
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r" ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?", r" ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?"
WIDE = {
    "email": rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,24}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){0,2}+",
}
#: Which texts can hold a match at all; cheap to test.
HINT = {"email": "contains(t, '@')", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9]([ -]?[0-9]){11}'", "phone": "contains(t, '+')"}
WIDE_HINT = {"email": r"t rlike '[\\[( ]dot[\\]) ]'", "ip": "t rlike ':[0-9A-Fa-f]{1,4}:'", "phone": "t rlike '[0-9][ .-][0-9]{4}'",
             "person": r"t rlike '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?)[.]? \\p{Lu}'"}
NAMES = ("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph "
         "jessica thomas sarah charles karen hans peter anna maria klaus ursula jean marie pierre jacques sophie claire "
         "jose juan carlos carmen luis ana miguel laura").split()
DOMAINS = "com org net edu gov io co info biz de fr es uk eu ch at it nl be us ca au".split()
CUES = {"email": "mail|contact|write|kontakt|courriel|correo", "ip": "ip|addr|host|server|login|client",
        "card": "card|visa|master|amex|credit|karte|carte|tarjeta", "phone": "phone|call|tel|fax|mobile|ruf|appel|llam",
        "person": "name|dear|sincerely|von|from|signed|liebe|cher|estimad"}
AGAINST = "version|release|isbn|order|invoice|serial|build|section|figure|chapter|page"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return (f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + "
            f"case when i % 2 = 0 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end) % 10 = 0")


#: Checks of a base match m.value.
VALID = {
    "email": "true",
    "ip": r"forall(split(m.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(concat('000', ltrim('0', p)), 3) as int) <= 255)",
    "card": f"case when length({_digits('m.value')}) between 12 and 19 then {_luhn(_digits('m.value'))} else false end",
    "phone": f"length({_digits('m.value')}) between 9 and 15",
}


def _spans(values: str, gaps: str) -> str:
    """Array of (start, end, value, left, right) in code points from the matches and what lies between them."""
    return (f"aggregate(sequence(0, size({values}) - 1), "
            "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string,left:string,right:string>>)), "
            f"(a, i) -> named_struct('at', a.at + length({gaps}[i]) + length({values}[i]), 'out', concat(a.out, array(named_struct("
            f"'start', a.at + length({gaps}[i]), 'end', a.at + length({gaps}[i]) + length({values}[i]), 'value', {values}[i], "
            f"'left', right({gaps}[i], 40), 'right', left({gaps}[i + 1], 1))))), a -> a.out)")


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then -1 else 0 end"


def _votes(kind: str, base: bool) -> str:
    """Named struct of the labelers' votes on m."""
    v, n = "lower(m.value)", f"length({_digits('m.value')})"
    names = ", ".join(f"'{x}'" for x in NAMES)
    tops = ", ".join(f"'{x}'" for x in DOMAINS)
    gazetteer = {
        "email": _vote(f"array_contains(array({tops}), regexp_extract({v}, '([a-z0-9]+)$', 1))", "true"),
        "ip": _vote("m.value rlike '^0*([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]'", "m.value rlike '^0*[.]|^(00|fe8)'"),
        "card": _vote("m.value rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)'", "true"),
        "phone": _vote("m.value rlike '^[+](1|33|34|49|44|41|43|39)'", "m.value rlike '^[+]0'"),
        "person": _vote(f"exists(split({v}, ' '), w -> array_contains(array({names}), w))")}[kind]
    shape = {
        "email": _vote(f"regexp_extract({v}, '^[^@( ]*', 0) rlike '[a-z]'", "true"),
        "ip": _vote("not m.value rlike '(^|[.])0[0-9]'", "true"),
        "card": _vote(f"{n} in (15, 16)", f"{n} < 13"),
        "phone": _vote(f"{n} between 10 and 13", "false"),
        "person": _vote("length(m.value) < 40", "true")}[kind]
    strict = "1" if base else {"card": "-1"}.get(kind, "0")
    return (f"'pattern', {strict}, 'gazetteer', {gazetteer}, 'context', "
            + _vote(f"lower(m.left) rlike '{CUES[kind]}'", f"lower(m.left) rlike '{AGAINST}'")
            + f", 'shape', {shape}, 'border', " + _vote(
                "not m.left rlike '[A-Za-z0-9]$' and not m.right rlike '^[A-Za-z0-9]'", "true"))


def _candidates(kind: str, base: bool, matched: str) -> str:
    number = KINDS.index(kind)
    fields = (f"named_struct('start', m.start, 'kind', {number}, 'end', m.end, 'base', {str(base).lower()}, " + _votes(kind, base) + ")")
    return f"transform({matched}, m -> {fields})"


def candidates(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``found``: every base match and proposal of the text with its votes, stored."""
    out = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("t"))
    sources = [("b_" + k, p, HINT[k]) for k, p in BASE.items()] + [("w_" + k, p, WIDE_HINT[k]) for k, p in WIDE.items()]
    for name, pattern, hint in sources:
        here = F.expr(hint)
        out = out.withColumn("v", F.when(here, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))) \
            .withColumn("v", F.when(F.size("v") > 0, F.col("v"))) \
            .withColumn("g", F.when(F.col("v").isNotNull(), F.split("t", pattern, -1))) \
            .withColumn(name, F.expr(f"case when v is not null then {_spans('v', 'g')} end")).drop("v", "g")
    parts = []
    for kind in BASE:
        parts.append(_candidates(kind, True, f"filter(b_{kind}, m -> {VALID[kind]})"))
    parts.append(_candidates("card", False, f"filter(b_card, m -> length({_digits('m.value')}) between 13 and 19 and not ({VALID['card']}))"))
    for kind in WIDE:
        parts.append(_candidates(kind, False, f"w_{kind}"))
    empty = "filter(array(named_struct('start', 0, 'kind', 0, 'end', 0, 'base', true, " + ", ".join(
        f"'{x}', 0" for x in LABELERS) + ")), x -> false)"
    joined = "concat(" + ", ".join(f"coalesce({p}, {empty})" for p in parts) + ")"
    return store(out.select(*[F.col(c) for c in carry], F.expr(joined).alias("found")), "candidates")


def reliabilities(patterns: list[tuple], rounds: int = 25) -> tuple[list[float], dict]:
    """(probability that a candidate of each pattern is true, reliability per labeler) by expectation maximisation.

    ``patterns`` has (kind, votes, base, count). Base matches are known to be true; the other truths are latent.
    """
    truth = [1.0 if base else min(0.9, max(0.1, 0.5 + 0.15 * sum(votes))) for _, votes, base, _ in patterns]
    chance = {}
    for _ in range(rounds):
        prior = {}
        for kind in {p[0] for p in patterns}:
            own = [(t, p[3]) for t, p in zip(truth, patterns) if p[0] == kind and not p[2]]
            prior[kind] = (1 + sum(t * n for t, n in own)) / (2 + sum(n for _, n in own))
        for j in range(len(LABELERS)):
            for side in (0, 1):
                mass = {v: 1.0 + (2.0 if v == 2 * side - 1 else 0.0) for v in VOTES}  # labelers beat chance
                for t, (_, votes, _, n) in zip(truth, patterns):
                    mass[votes[j]] += n * (t if side else 1 - t)
                total = sum(mass.values())
                chance[j, side] = {v: m / total for v, m in mass.items()}
        for i, (kind, votes, base, _) in enumerate(patterns):
            if not base:
                odds = math.log(prior[kind] / (1 - prior[kind])) + sum(
                    math.log(chance[j, 1][v] / chance[j, 0][v]) for j, v in enumerate(votes))
                truth[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth, {LABELERS[j]: (chance[j, 1], chance[j, 0]) for j in range(len(LABELERS))} if patterns else {}


def _features(kind: int, votes) -> list[float]:
    return [1.0] + [float(kind == k) for k in range(len(KINDS))] + [float(v == s) for v in votes for s in (1, -1)]


def span_classifier(patterns: list[tuple], truth: list[float], rounds: int = 200) -> list[float]:
    """Logistic weights of ``_features`` fitted to the probabilities, pattern counts as square-root weights."""
    rows = [(_features(k, v), t, math.sqrt(n)) for (k, v, _, n), t in zip(patterns, truth)]
    size = 1 + len(KINDS) + 2 * len(LABELERS)
    weights, total = [0.0] * size, sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [0.002 * w for w in weights]
        for x, t, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            for i, a in enumerate(x):
                slope[i] += (p - t) * a * n / total
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def find_spans(docs: DataFrame, *, text: str = "text", carry: list[str], sure: float = 0.9) -> DataFrame:
    """``carry`` columns, ``base`` and ``spans``: sorted arrays of (start, kind, end); kind counts in KINDS."""
    found = candidates(docs, text, carry)
    table = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.base", *[f"c.{x}" for x in LABELERS]).count()
    patterns = [(r["kind"], tuple(r[x] for x in LABELERS), r["base"], r["count"]) for r in table.collect()]  # bounded: kinds * 2 * 3**5
    patterns.sort()
    truth, _ = reliabilities(patterns)
    w = span_classifier(patterns, truth)
    score = " + ".join([f"({w[0]!r})"] + [f"(case when c.kind = {k} then {w[1 + k]!r} else 0 end)" for k in range(len(KINDS))] + [
        f"(case when c.{x} = {s} then {w[1 + len(KINDS) + 2 * j + i]!r} else 0 end)" for j, x in enumerate(LABELERS) for i, s in enumerate((1, -1))])
    agree = " + ".join(f"case when c.{x} = 1 then 1 else 0 end" for x in LABELERS)
    cut = math.log(sure / (1 - sure))
    plain = "x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)"
    return found.withColumn("b", F.expr("filter(found, c -> c.base)")) \
        .withColumn("base", F.expr(f"sort_array(transform(b, {plain}))")) \
        .withColumn("spans", F.expr(
            f"sort_array(transform(filter(found, c -> c.base or ({score} >= {cut!r} and {agree} >= 2 and "
            f"not exists(b, x -> x.start < c.end and c.start < x.end))), {plain}))")).select(*carry, "base", "spans")


def _text_of(spans: str) -> F.Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({kinds}[x.kind], ':', x.start, ':', x.end)), ',')")


def personal_data(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; counts and digest are of the base spans.

    Null texts are empty; a text without spans has the digest of the empty string. Null ids and repeated rows stay.
    Base spans of different kinds may overlap and all stay. An empty table gives an empty result.
    """
    found = find_spans(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), carry=["id"])
    return found.select(
        F.col("id").alias(id), *[F.expr(f"cast(size(filter(base, x -> x.kind = {n})) as bigint)").alias(f"n_{k}")
                                 for n, k in enumerate(KINDS[:4])],
        F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; of overlapping ones the first names it.

    A null text stays null. Columns named ``base``, ``spans``, ``found``, ``t``, ``b`` are kept as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    found = find_spans(docs.toDF(*names), text=at, carry=names)
    kinds = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    pieces = (f"aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> named_struct("
              f"'at', greatest(a.at, x.end), 'out', case when x.start >= a.at then concat(a.out, array(substring({at}, a.at + 1, x.start - a.at), "
              f"{kinds}[x.kind])) else a.out end), a -> concat(array_join(a.out, ''), substring({at}, a.at + 1, length({at}))))")
    return found.select(*[(F.expr(f"case when size(spans) > 0 then {pieces} else {at} end") if c == at else F.col(c)).alias(o)
                          for c, o in zip(names, docs.columns)])
