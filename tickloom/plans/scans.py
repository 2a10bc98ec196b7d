"""Recurrences along a blocked series, written with windows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.blocks import BEFORE, BLOCK, OWN, SO_FAR, SPLIT, TIME, Blocks, Part, over
from tickloom.schema import time_key

# Decay after which an old value has faded to nothing (e^-300); e^600 times any price stays far below overflow.
STRETCH = 300.0
# Smallest share of the fastest decay that a slower one must have to use the same stretches.
ALIKE = 0.15
RUN_ORDER = f"_run, {TIME}"


def decay_rate(alpha: float) -> float:
    return -math.log1p(-alpha)


@dataclass(frozen=True)
class Smooth:
    """An exponential mean y = (1-a)*y' + a*x of an SQL expression x, seeded at its first value.

    ``there`` is null on the same rows as x. A gap of k nulls repeats y and then weighs the old mean by (1-a)^(k+1)
    against a.
    """
    x: str
    alpha: float
    there: str = ""

    @property
    def pattern(self) -> str:
        return self.there or self.x

    @property
    def rate(self) -> float:
        return decay_rate(self.alpha)

    def decay(self, m: str) -> str:
        """SQL of the log decay that a value brings ``m`` rows after the one before."""
        return f"least({self.rate!r}D * {m} + ln(exp(-{self.rate!r}D * {m}) + {self.alpha!r}D), {STRETCH}D)"

    def weight(self, m: str) -> str:
        """SQL of the value's share in the new mean."""
        return f"({self.alpha!r}D / (exp(-{self.rate!r}D * {m}) + {self.alpha!r}D))"


def _share(slow: Smooth, fast: Smooth) -> float:
    """The least decay of ``slow`` against ``fast`` over all gaps."""
    decay = lambda s, m: s.rate * m + math.log(math.exp(-s.rate * m) + s.alpha)
    return min(decay(slow, m) / decay(fast, m) for m in (*range(1, 200), *(1.1 ** k for k in range(56, 250))))


def _clusters(rules: list[Smooth]) -> list[list[Smooth]]:
    """Rules of one pattern by falling decay, cut where one is too slow to share its first's stretches."""
    out = []
    for rule in sorted(rules, key=lambda r: -r.rate):
        if out and _share(rule, out[-1][0]) >= ALIKE:
            out[-1].append(rule)
        else:
            out.append([rule])
    return out


def add_smooth(df: DataFrame, blocks: Blocks, smooth: dict[str, Smooth], seen: dict[str, str] | None = None) -> DataFrame:
    """Exponential means by name, in one form for series with and without nulls, whole or in blocks.

    A value maps the mean before it to d*y + c, a null leaves it; such maps compose to maps of the same kind. Inside a
    block the composition is a decayed sum: with L the running log decay, y = sum(c * e^(L_c - L)), taken in stretches of
    ``STRETCH`` in L, since what lies before the stretch before has faded. Over blocks, one row each, maps are
    composed with the rows 1, 2, 4, ... blocks back. Rows of a block before its first value show the mean it starts
    from, halo rows as well. ``seen`` gives patterns for which the number of values so far is added, by name.

    Needs ``_i``, the row number, and orders by ``RUN_ORDER`` at the end.
    """
    part, seen = blocks.part, seen or {}
    patterns = list(dict.fromkeys([r.pattern for r in smooth.values()] + list(seen.values())))
    tag = {p: n for n, p in enumerate(patterns)}
    rules = dict.fromkeys(smooth.values())
    x, z = {n: f"_x{i}" for i, n in enumerate(smooth)}, {n: f"_z{i}" for i, n in enumerate(smooth)}
    sliding = {n: r for n, r in smooth.items() if r.alpha < 1}
    level = {r: f"_d{i}" for i, r in enumerate(dict.fromkeys(Smooth(r.pattern, r.alpha) for r in rules if r.alpha < 1))}
    of = lambda r: level[Smooth(r.pattern, r.alpha)]
    mine = f"`{OWN}` AND " if blocks.split else ""
    first, so_far = over(part, frame=BEFORE), over(part, frame=SO_FAR)

    df = df.selectExpr("*", *[f"double(CASE WHEN {mine}true THEN {r.x} END) AS {x[n]}" for n, r in smooth.items()],
                       *[f"{mine}({p}) IS NOT NULL AS _t{k}" for p, k in tag.items()])
    df = df.selectExpr(
        "*", *[f"_i - last(CASE WHEN _t{k} THEN _i END, true) {first} AS _m{k}" for k in tag.values()],
        *[f"count_if(_t{k}) {so_far} AS _v{k}" for k in tag.values()],
        *[f"first({x[n]}, true) {so_far} AS _f{i}" for i, n in enumerate(smooth)],
        *[f"last({x[n]}, true) {so_far} AS {z[n]}" for n, r in smooth.items() if r.alpha >= 1])
    later = lambda r: f"_t{tag[r.pattern]} AND _m{tag[r.pattern]} IS NOT NULL"  # noqa: E731  the block's first value is left to its start
    gap = lambda r: f"double(_m{tag[r.pattern]})"
    df = df.selectExpr("*", *[f"CASE WHEN {later(r)} THEN {r.decay(gap(r))} ELSE 0D END AS {d}" for r, d in level.items()])
    df = df.selectExpr("*", *[f"sum({d}) {so_far} AS {d}_all" for d in level.values()])
    groups = [g for p in patterns for g in _clusters([r for r in level if r.pattern == p])]
    for number, group in enumerate(groups):
        stretch = "_run" if number == len(groups) - 1 else f"_s{number}"
        df = df.drop(stretch).selectExpr("*", f"floor({level[group[0]]}_all / {STRETCH}D) AS {stretch}")
        inside, names = over(part.plus(stretch), frame=SO_FAR), [n for n, r in sliding.items() if Smooth(r.pattern, r.alpha) in group]
        df = df.selectExpr("*", *[f"sum({level[r]}) {inside} AS {level[r]}_in" for r in group])
        df = df.selectExpr("*", *[f"""coalesce(sum(CASE WHEN {later(sliding[n])} THEN {sliding[n].weight(gap(sliding[n]))} * {x[n]}
            * exp({of(sliding[n])}_in) END) {inside}, 0D) * exp(-{of(sliding[n])}_in) AS {z[n]}""" for n in names])
        df = df.selectExpr("*", f"lag(struct({', '.join(z[n] for n in names)})) {over(part, f'{stretch}, {TIME}')} AS _last")
        df = df.selectExpr("*", f"first(_last) {inside} AS _carry")
        df = df.selectExpr(*[c for c in df.columns if c not in {z[n] for n in names} | {"_last", "_carry"}],
                           *[f"{z[n]} + coalesce(_carry.{z[n]}, 0D) * exp(-{of(sliding[n])}_in) AS {z[n]}" for n in names])
    if not groups:
        df = df.drop("_run").selectExpr("*", "0L AS _run")
    if blocks.split:
        starts = _smooth_starts(df.filter(SPLIT).filter(OWN), blocks, smooth, tag, x, z, {n: of(r) for n, r in sliding.items()})
        df = df.join(starts, part, "left")
        begin = {n: f"CASE WHEN {SPLIT} THEN _first{i} ELSE _f{i} END" for i, n in enumerate(smooth)}
        before = {n: f"_in{i}" for i, n in enumerate(smooth)}
    else:
        begin, before = {n: f"_f{i}" for i, n in enumerate(smooth)}, dict.fromkeys(smooth, "double(NULL)")
    out = {n: f"coalesce({z[n]}, {before[n]})" if r.alpha >= 1 else
           f"CASE WHEN _f{i} IS NULL THEN {before[n]} ELSE {z[n]} + exp(-{of(r)}_all) * ({begin[n]}) END"
           for i, (n, r) in enumerate(smooth.items())}
    counts = {n: f"_v{tag[p]}" + (f" + coalesce(_seen{tag[p]}, 0L)" if blocks.split else "") for n, p in seen.items()}
    df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in {**out, **counts}.items()])
    ours = re.compile(r"_(x|z|t|m|v|f|d|s|in|first|seen)\d+(_all|_in)?")
    return df.drop(*[c for c in df.columns if ours.fullmatch(c)])


def _smooth_starts(own: DataFrame, blocks: Blocks, smooth: dict[str, Smooth], tag: dict[str, int], x: dict, z: dict, level: dict) -> DataFrame:
    """Per block of a split series: the means it starts from (``_in``), its means at its first values (``_first``), values before it."""
    line, names = over([*blocks.keys, SPLIT], BLOCK, BEFORE), list(enumerate(smooth))
    ends = own.groupBy(*blocks.part).agg(
        F.min("_i").alias("_at"), F.count("*").alias("_n"), F.max_by(F.struct(
            *[f"_v{k}" for k in tag.values()], *[f"_f{i}" for i, _ in names], *z.values(), *[f"{d}_all" for d in dict.fromkeys(level.values())]), time_key(own)).alias("_end"),
        *[F.expr(f"min(CASE WHEN _t{k} THEN _i END)").alias(f"_lead{k}") for k in tag.values()],
        *[F.expr(f"max(CASE WHEN _t{k} THEN _i END)").alias(f"_tail{k}") for k in tag.values()])
    df = ends.selectExpr("*", "_end.*").selectExpr("*", f"coalesce(sum(_n) {line}, 0L) AS _start")
    df = df.selectExpr("*", *[f"coalesce(sum(_v{k}) {line}, 0L) AS _seen{k}" for k in tag.values()],
                       *[f"double(_start + _lead{k} - _at - max(_start + _tail{k} - _at) {line}) AS _gap{k}" for k in tag.values()])
    kind = [(i, n, smooth[n], tag[smooth[n].pattern]) for i, n in names]
    share = {n: "1D" if r.alpha >= 1 else f"CASE WHEN _gap{k} IS NULL THEN 1D ELSE {r.weight(f'_gap{k}')} END" for _, n, r, k in kind}
    df = df.selectExpr("*", *[f"{share[n]} AS _w{i}" for i, n, _, _ in kind])
    maps = []
    for i, n, r, k in kind:
        fade = "0D" if r.alpha >= 1 else f"exp(-{level[n]}_all)"
        maps += [f"CASE WHEN _v{k} = 0 THEN 1D ELSE {fade} * (1D - _w{i}) END AS _D{i}",
                 f"CASE WHEN _v{k} = 0 THEN 0D ELSE {z[n]} + {fade} * _w{i} * _f{i} END AS _C{i}"]
    df = df.selectExpr("*", *maps)
    step, all_ = 1, ", ".join(f"_D{i}, _C{i}" for i, _ in names)
    while step < blocks.most:
        df = df.selectExpr("*", f"lag(struct({all_}), {step}) {over([*blocks.keys, SPLIT], BLOCK)} AS _p")
        df = df.selectExpr(*[c for c in df.columns if not re.fullmatch(r"_[DC]\d+|_p", c)],
                           *[f"_D{i} * coalesce(_p._D{i}, 1D) AS _D{i}" for i, _ in names],
                           *[f"_C{i} + _D{i} * coalesce(_p._C{i}, 0D) AS _C{i}" for i, _ in names])
        step *= 2
    df = df.selectExpr("*", *[f"CASE WHEN _seen{k} > 0 THEN lag(_C{i}) {over([*blocks.keys, SPLIT], BLOCK)} END AS _in{i}" for i, _, _, k in kind])
    return df.selectExpr(*[f"`{c}`" for c in blocks.part], *[f"_in{i}" for i, _ in names], *[f"_seen{k}" for k in tag.values()],
                         *[f"coalesce((1D - _w{i}) * _in{i}, 0D) + CASE WHEN _in{i} IS NULL THEN 1D ELSE _w{i} END * _f{i} AS _first{i}" for i, _ in names])


def add_means(df: DataFrame, part: Part, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Sliding means of the last n rows, null unless all have values, in constant work per row.

    Rows are grouped in runs of the largest n, with running sums and counts inside each. A mean is a difference of
    two running sums, plus the previous run's total where the window reaches into it (Spark would re-add
    a sliding frame for every row); over equal values it is the value itself, which sums miss by a rounding.

    Needs ``_i`` and adds ``_run``, after which rows are in the order ``RUN_ORDER``.
    """
    run = max(n for _, n in means.values())
    columns = list(dict.fromkeys(c for c, _ in means.values()))
    total, count = {c: f"_sum_{c}" for c in columns}, {c: f"_num_{c}" for c in columns}
    before = {c: f"_before_{c}" for c in columns}
    df = df.selectExpr("*", f"_i div {run} AS _run", f"_i % {run} AS _j", *[f"lag({c}) {over(part)} AS {b}" for c, b in before.items()])
    inside, order = over(part.plus("_run"), frame=SO_FAR), over(part, RUN_ORDER)
    df = df.selectExpr("*", *[f"coalesce(sum({c}) {inside}, 0D) AS {total[c]}" for c in columns], *[f"count({c}) {inside} AS {count[c]}" for c in columns])

    def ahead(value: str) -> str:
        return f"last(CASE WHEN _j = {run - 1} THEN {value} END, true) {over(part, RUN_ORDER, BEFORE)}"

    df = df.selectExpr(
        "*", *[f"{ahead(t)} AS {t}_run" for t in (*total.values(), *count.values())],
        *[f"max(CASE WHEN {b} IS NULL OR {c} <> {b} THEN _i END) {over(part, RUN_ORDER, SO_FAR)} AS _level_{c}" for c, b in before.items()],
        *[f"lag({total[c]}, {n}, 0D) {order} AS _lag_{o}" for o, (c, n) in means.items()],
        *[f"lag({count[c]}, {n}, 0L) {order} AS _had_{o}" for o, (c, n) in means.items()])

    def window(t: str, old: str, n: int) -> str:
        return f"({t} - {old} + CASE WHEN _j < {n} THEN coalesce({t}_run, 0) ELSE 0 END)"

    df = df.selectExpr("*", *[f"""CASE WHEN {window(count[c], f'_had_{o}', n)} = {n} THEN
        CASE WHEN _i - _level_{c} >= {n - 1} THEN double({c}) ELSE {window(total[c], f'_lag_{o}', n)} / {n} END END AS {o}"""
                              for o, (c, n) in means.items()])
    return df.drop("_j", *before.values(), *[f"_level_{c}" for c in columns], *[f"_{k}_{o}" for o in means for k in ("lag", "had")],
                   *[c for t in (*total.values(), *count.values()) for c in (t, f"{t}_run")])


def toggle_signals(blocks: Blocks, masks: Callable[[DataFrame], DataFrame],
                   order: str = TIME) -> DataFrame:
    """BUY / SELL from ``_entry`` and ``_exit`` acting in turn, at most one action per row.

    Per row: entry only sets the state to in, exit only sets it to out, both flip it, none keeps
    it. The state is the last set value plus the flips since, modulo 2. Of earlier blocks only
    their end state matters: one row per block is folded and joined back.
    """
    part = blocks.part

    def local(df):
        df = df.selectExpr("*", f"sum(int(_entry AND _exit)) {over(part, order, SO_FAR)} AS _flips")
        return df.selectExpr("*", f"""last(CASE WHEN _entry <> _exit THEN
            struct(int(_entry) AS to, _flips AS flips) END, true) {over(part, order, SO_FAR)} AS _set""")

    df = local(blocks.own(masks(blocks.frame)))
    if blocks.split:
        df = df.join(_block_states(blocks, local(blocks.own(masks(blocks.frame.filter(SPLIT))))), part, "left")
    else:
        df = df.withColumn("_start", F.lit(0))
    df = df.selectExpr("*", """CASE WHEN _set IS NULL THEN (coalesce(_start, 0) + _flips) % 2
        ELSE (_set.to + _flips - _set.flips) % 2 END AS _state""")
    df = df.selectExpr("*", f"coalesce(lag(_state) {over(part, order)}, _start, 0) AS _was")
    return df.selectExpr("*", """CASE WHEN _state > _was THEN 'BUY'
        WHEN _state < _was THEN 'SELL' END AS signal""").drop("_flips", "_set", "_start", "_state", "_was")


def _block_states(blocks: Blocks, local: DataFrame) -> DataFrame:
    """State before each block."""
    line = [*blocks.keys, SPLIT]
    ends = local.groupBy(*blocks.part).agg(F.max_by(F.struct("_flips", "_set"), time_key(local)).alias("_end"))
    ends = ends.selectExpr(
        "*", f"sum(_end._flips) {over(line, BLOCK, SO_FAR)} AS _all",
        f"coalesce(sum(_end._flips) {over(line, BLOCK, BEFORE)}, 0) AS _base")
    ends = ends.selectExpr("*", f"""last(CASE WHEN _end._set IS NOT NULL THEN struct(_end._set.to AS to,
        _base + _end._set.flips AS flips) END, true) {over(line, BLOCK, SO_FAR)} AS _fixed""")
    ends = ends.selectExpr(
        "*", "(coalesce(_fixed.to, 0) + _all - coalesce(_fixed.flips, 0)) % 2 AS _out")
    return ends.selectExpr(*blocks.part, f"lag(_out) {over(line, BLOCK)} AS _start")
