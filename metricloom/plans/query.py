"""Queries: plain measures in one aggregation, window measures over the cells at their order grain."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from metricloom.functions.time import DAYS, MONTHS, interval, shift
from metricloom.plans import cells as C
from metricloom.plans import settle as S
from metricloom.plans.model import (
    Condition,
    Dimension,
    Measure,
    MetricView,
    Window,
    mentions,
    qualifiers,
)


# A sliding frame is aggregated anew for every row; from this length on blocks are cheaper.
SLIDING_DAYS = 31


def run(
    mv: MetricView,
    spark: SparkSession,
    measures: Sequence[str | Measure],
    dims: Sequence[str | Dimension] = (),
    where: Condition | Iterable[Condition] | None = None,
    limit: int | None = None,
    relationship: str | None = None,
) -> DataFrame:
    resolved = [mv.measure(m) for m in measures]
    grain = [mv.dim(d) for d in dims]
    names = [d.name for d in grain]
    where = C.conditions(where)
    specs = list(dict.fromkeys(m.window for m in resolved))
    shared = _shared_cells(mv, spark, resolved, specs, grain, where, relationship) if len(specs) > 1 else None
    frames = []
    for spec in sorted(specs, key=bool):
        same_spec = [m for m in resolved if m.window == spec]
        if spec:
            frames.append(windowed(mv, spark, same_spec, spec, grain, where, relationship, shared))
        elif shared:
            cells = shared.only(same_spec)
            for cond in _split_by(mv, specs, where)[1]:
                cells = C.replace(cells, df=cells.df.where(C.as_column(cond)))
            frames.append(cells.regroup(names).values())
        else:
            frames.append(C.build(mv, spark, same_spec, grain, where, relationship).values())
    df = frames[0]
    for other in frames[1:]:
        df = C.join_on(df, other, names)
    df = df.select(*[F.col(f"`{n}`") for n in (*names, *[m.name for m in resolved])])
    if limit is not None:
        df = df.orderBy(*[F.col(f"`{n}`") for n in names]).limit(limit)
    return df


def _split_by(mv: MetricView, specs: Sequence[tuple[Window, ...]], where: Sequence[Condition]):
    """Conditions before and after the windows, or None where the windows disagree."""
    splits = [split_conditions(mv, where, *(mv.dim(w.order) for w in leading_entries(s))) for s in specs if s]
    # Conditions may be columns, which cannot be compared; their positions can.
    marks = {tuple(any(c is e for e in early) for c in where) for early, _ in splits}
    return splits[0] if len(marks) == 1 else None


def _shared_cells(mv, spark, measures, specs, dims, where, relationship) -> C.Cells | None:
    """Cells fine enough for all the measures of a query, so that the facts are read once.

    Not for distinct counts, which do not merge, nor for windows that split the conditions
    differently.
    """
    if not all(leaf.mergeable for leaf in C.leaves_of(measures)):
        return None
    split = _split_by(mv, specs, where)
    if split is None:
        return None
    grain = {d.name: d for d in dims}
    for s in specs:
        grain |= {w.order: mv.dim(w.order) for w in s}
    grain |= {d.name: d for d in C.with_filtered_dims(mv, [], split[1])}
    return C.build(mv, spark, measures, list(grain.values()), split[0], relationship).settled()


def leading_entries(spec: tuple[Window, ...]) -> list[Window]:
    """The entries that give the frame: those that are not `current`, else the first one."""
    return [w for w in spec if w.normal_range != "current"] or [spec[0]]


def is_period(mv: MetricView, d: Dimension, order: Dimension) -> bool:
    """The dimension is the order dimension or a period of it (its year, its month ...).

    Attributes of a calendar count as periods when the order dimension is the calendar's join key.
    """
    if d.name == order.name or d.period_of == order.name or mentions(d.expr, order.expr):
        return True
    calendars = {
        j.name
        for j in mv.joins
        if any(order.expr in c.replace("`", "").split() for c in (j.condition(), *j.alternates.values()))
    }
    return bool(qualifiers(d.expr) & calendars)


def split_conditions(
    mv: MetricView, where: Sequence[Condition], *orders: Dimension
) -> tuple[list[Condition], list[Condition]]:
    """Conditions for before and after the window: those on the order dimensions come after (Q3)."""
    early, late = [], []
    for cond in where:
        named = [d for d in mv.dimensions if mentions(C.condition_text(cond), d.name)]
        timed = [d for d in named if any(is_period(mv, d, o) for o in orders)]
        if timed and len(timed) < len(named):
            raise ValueError(f"give conditions on time and on other dimensions separately: {cond}")
        (late if timed else early).append(cond)
    return early, late


def columns(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def windowed(
    mv: MetricView,
    spark: SparkSession,
    measures: Sequence[Measure],
    spec: tuple[Window, ...],
    dims: Sequence[Dimension],
    where: Sequence[Condition],
    relationship: str | None = None,
    shared: C.Cells | None = None,
) -> DataFrame:
    """Measures with the same window entries.

    `current` entries become partition keys. The others give the frame; it runs over cells at
    (dimensions, orders) grain, so a window never sees more rows per partition than the order
    dimension has members. When an order dimension is not queried, its last (or first) value is
    taken per group; of several, first that of the later entries.
    """
    lead = leading_entries(spec)
    orders = [mv.dim(w.order) for w in lead]
    currents = [mv.dim(w.order) for w in spec if not any(w is x for x in lead)]
    early, late = split_conditions(mv, where, *orders)
    timed = lambda d: any(is_period(mv, d, o) for o in orders)
    entity = [d for d in dims if not timed(d)]
    hidden = C.with_filtered_dims(mv, [], late)
    grain = list({d.name: d for d in (*dims, *currents, *hidden, *orders)}.values())
    keys = list(dict.fromkeys(d.name for d in (*entity, *currents)))
    names = [d.name for d in grain]

    distinct = [leaf for leaf in C.leaves_of(measures) if not leaf.mergeable]
    framed = lead[0].normal_range != "current"
    if len(lead) > 1 and distinct:
        raise ValueError("a distinct count may have one ordered window entry besides `current` entries")
    if shared:
        cells = shared.only(measures).regroup(names)
    elif framed and distinct:
        cells = over_distinct(mv, spark, measures, distinct, grain, early, relationship, keys, lead[0])
    else:
        cells = C.build(mv, spark, measures, grain, early, relationship)
    if framed:
        cells = over_frames(cells, keys, lead)
    df = cells.values()
    for cond in late:
        df = df.where(C.as_column(cond))
    names = [d.name for d in dims]
    extras = [d for d in grain if d.name not in names]
    if all(o.name in names for o in orders) and all(timed(d) for d in extras):
        return df.select(*columns(names), *columns(m.name for m in measures))
    others = [d.name for d in extras if d.name not in [o.name for o in orders]]
    for i in reversed(range(len(lead))):
        if others or orders[i].name not in names:
            kept = [*names, *[o.name for o in orders[:i] if o.name not in names]]
            by, others = F.struct(*columns([orders[i].name, *others])), []
            pick = F.min_by if lead[i].semiadditive == "first" else F.max_by
            values = [pick(F.col(f"`{m.name}`"), by).alias(m.name) for m in measures]
            df = df.groupBy(*columns(kept)).agg(*values)
    return df


def frame_text(keys: Sequence[str], order: str, bounds: str) -> str:
    part = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys) if keys else ""
    return f"{part} ORDER BY `{order}` RANGE BETWEEN {bounds}"


def over_distinct(mv, spark, measures, distinct, grain, early, relationship, keys, w: Window) -> C.Cells:
    """Cells whose distinct counts are already those of the frames; the other parts are still plain."""
    leaves = C.leaves_of(measures)
    additive = tuple(leaf for leaf in leaves if leaf.mergeable)
    keyed = [[*grain, Dimension("__key", leaf.input())] for leaf in distinct]
    by_day = _by_day(w, dict(C.project(mv, spark, [], grain, relationship).dtypes)[w.order])
    if len(distinct) == 1 and w.normal_range != "all" and by_day:
        fine = C.build(mv, spark, measures, keyed[0], early, relationship, leaves=additive)
        cells = _count_along(fine, [d.name for d in grain], keys, w)
        return C.replace(cells, leaves=leaves)
    cells = C.build(mv, spark, measures, grain, early, relationship, leaves=additive).settled()
    anchors = cells.df.select(*columns([*keys, w.order])).distinct()
    df = cells.df
    for i, dims in enumerate(keyed, start=len(additive)):
        rows = C.build(mv, spark, [], dims, early, relationship).df.select(*columns([*keys, w.order]), "__key")
        counts = distinct_over(rows.where("__key IS NOT NULL").distinct(), anchors, keys, w.order, w)
        df = C.join_on(df, counts.withColumnRenamed("__count", f"__{i}v"), [*keys, w.order])
    return C.replace(cells, df=df, leaves=leaves)


def _by_day(w: Window, kind: str) -> bool:
    """The frame counts whole days of a date, or has no length."""
    return not w.span or kind == "date" and w.span[2] != "hour"


def _count_along(fine: C.Cells, names: Sequence[str], keys: Sequence[str], w: Window) -> C.Cells:
    """Cells with the distinct count of `__key` in the frame, from cells per counted value.

    Every row sends its parts to its own date and up to two events to the dates where its value
    starts and ceases to be in sight. One aggregation per date brings them together, a running sum
    of the events is the count: one pass over the facts and no join.
    """
    order = w.order
    day = F.col(f"`{order}`")
    start, end = _run_of(day, W.partitionBy(*columns(keys), F.col("__key")).orderBy(day), w)
    parts = [n for i in range(len(fine.leaves)) for n in fine.part_names(i).values()]
    others = [n for n in names if n not in (*keys, order)]
    if w.normal_range == "cumulative" and dict(fine.df.dtypes)[order] != "date":
        # A frequent value may have any number of timestamps: its first one is an aggregate.
        fine = fine.settled()
        known = fine.df.where("__key IS NOT NULL").groupBy(*columns(keys), "__key").agg(F.min(day).alias(order))
        firsts = known.withColumn("__start", day).unionByName(fine.df.drop("__key"), allowMissingColumns=True)
        marked = firsts.withColumn("__end", F.lit(None).cast("date"))
    else:
        marked = fine.df.withColumn("__start", start).withColumn("__end", end)
    in_sight = F.col("__key").isNotNull() & F.col("__start").isNotNull()
    carried = [F.col(f"`{n}`") for n in (*parts, *others)]
    types = dict(fine.df.dtypes)

    def sent(at: Column, delta: int, anchor: bool) -> Column:
        given = carried if anchor else [F.lit(None).cast(types[n]) for n in (*parts, *others)]
        named = [c.alias(f"c{i}") for i, c in enumerate(given)]
        return F.struct(at.alias("__day"), F.lit(delta).alias("__delta"), F.lit(anchor).alias("__anchor"), *named)

    begins = F.when(in_sight & F.coalesce(F.col("__start") <= F.col("__end"), F.lit(True)), F.col("__start"))
    ceases = F.when(begins.isNotNull(), F.date_add("__end", 1))
    events = F.array(sent(day, 0, True), sent(begins, 1, False), sent(ceases, -1, False))
    flat = marked.select(*columns(keys), F.inline(F.filter(events, lambda e: e["__anchor"] | e["__day"].isNotNull())))
    merged = {n: fn for i in range(len(fine.leaves)) for n, fn in _merge_names(fine, i).items()}
    daily = flat.groupBy(*columns(keys), "__day").agg(
        F.sum("__delta").alias("__delta"),
        F.max("__anchor").alias("__anchor"),
        *[merged[n](f"c{i}").alias(n) for i, n in enumerate(parts)],
        *[F.max(f"c{len(parts) + i}").alias(n) for i, n in enumerate(others)],
    )
    df = _running_sum(daily, keys, f"__{len(fine.leaves)}v").where("__anchor").withColumnRenamed("__day", order)
    return C.replace(fine, df=df.drop("__delta", "__anchor"), dims=tuple(names))


def _merge_names(cells: C.Cells, i: int) -> dict:
    leaf = cells.leaves[i]
    return {n: (lambda c, p=p: leaf.merge(p, F.col(c))) for p, n in cells.part_names(i).items()}


def _run_of(day: Column, by_key, w: Window) -> tuple[Column, Column]:
    """First and last anchor that see an occurrence of a value and no nearer one.

    The end is NULL where the value stays in sight for good.
    """
    if w.normal_range == "cumulative":
        return F.when(F.lag(day).over(by_key).isNull(), day), F.lit(None).cast("date")
    side, n, unit = w.span
    if side == "trailing":
        seen = F.date_sub(day, 1) if w.include_anchor else day
        return F.date_add(seen, 1), F.least(_last_anchor(seen, n, unit), F.lead(seen).over(by_key))
    seen = F.date_add(day, 1) if w.include_anchor else day
    return F.greatest(_first_anchor(seen, n, unit), F.lag(seen).over(by_key)), F.date_sub(seen, 1)


def over_frames(cells: C.Cells, keys: Sequence[str], windows: Sequence[Window]) -> C.Cells:
    """Cells with each part merged over the rows that lie in the frames of all the windows.

    One window's axis is cut into dyadic stretches: every row lies in one stretch per length (1, 2,
    4, ...), and any frame is made of at most two stretches per length. With the stretch as one more
    key the other windows are answered as if it were not there, and what a cell's stretches come to
    is merged. The work is the cells times the logarithm of the axis, and there is no product of the
    two axes. Rows without a value on the axis come before all others, as in a window.
    """
    if len(windows) == 1:
        return over_frame(cells, keys, windows[0].order, windows[0])
    cells = cells.settled()
    kinds = dict(cells.df.dtypes)
    inner = next((w for w in windows if kinds[w.order] == "date"), windows[-1])
    others = [w for w in windows if w is not inner]
    here, low, high = _stretch(inner, kinds[inner.order])
    first, last = cells.df.agg(F.min(here), F.max(here)).first()
    first, last = first or 0, last or 0
    top = last - first + 1
    place = lambda c: c - F.lit(first - 1)
    pos = F.coalesce(place(here), F.lit(0).cast("bigint"))
    begin = F.when(here.isNull(), 0).otherwise(F.lit(0) if low is None else F.greatest(place(low), F.lit(1)))
    end = F.when(here.isNull(), 0).otherwise(F.least(place(high), F.lit(top)))
    if inner.normal_range == "all":
        begin, end = F.lit(0), F.lit(top)
    halved = lambda c, k: F.call_function("shiftright", c.cast("bigint"), k)
    lengths = F.sequence(F.lit(0), F.lit(top.bit_length()))
    node = lambda k, n: F.struct(k.alias("k"), n.cast("bigint").alias("n"))

    def cover(k: Column) -> Column:
        """The stretches of length 2^k in the smallest cover of begin .. end."""
        after = halved(end + 1, k)
        left = halved(begin + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        ends = F.array(F.when(odd(left), node(k, left)), F.when(odd(after), node(k, after - 1)))
        return F.when(left < after, F.array_distinct(F.array_compact(ends))).otherwise(F.array().cast("array<struct<k:int,n:bigint>>"))

    parts = [n for i in range(len(cells.leaves)) for n in cells.part_names(i).values()]
    rest = [c for c in cells.df.columns if c not in parts]
    stretch = f"__stretch{len(windows)}"
    grain = list(dict.fromkeys([*keys, *[w.order for w in others], stretch]))
    given = cells.df.withColumn(stretch, F.explode(F.transform(lengths, lambda k: node(k, halved(pos, k)))))
    if low is None:  # a frame that is open at its beginning is made of stretches of even number
        given = given.where(F.col(f"{stretch}.n") % 2 == 0)
    asked = S.settle(cells.df.select(*columns(rest), F.explode_outer(F.flatten(F.transform(lengths, cover))).alias(stretch)))
    places = asked.where(F.col(stretch).isNotNull()).select(*columns(grain)).distinct()
    both = given.select(*columns(grain), *parts).unionByName(places, allowMissingColumns=True)
    fine = C.replace(cells, df=both, dims=tuple(grain)).regroup(grain)
    answers = over_frames(fine, [*keys, stretch], others).df
    met = C.join_hot(asked, answers.select(*columns(grain), *parts), grain)
    return C.replace(cells, df=C.replace(cells, df=met).regroup(rest).df)


def _stretch(w: Window, kind: str) -> tuple[Column, Column | None, Column]:
    """An order column on an axis of whole numbers (days, microseconds), and both ends of its frame, the first
    None where it is open."""
    day = _by_day(w, kind) and kind == "date"
    here = F.col(f"`{w.order}`")
    number = (lambda c: F.unix_date(c).cast("bigint")) if day else (lambda c: F.unix_micros(c.cast("timestamp")))
    at = number(here)
    if not w.span:
        return at, None, at
    side, n, unit = w.span
    trailing = side == "trailing"
    if unit in MONTHS:
        months = n * MONTHS[unit] * (-1 if trailing else 1)
        far = number(F.add_months(here, F.lit(months)) if day else here.cast("timestamp") + F.make_ym_interval(F.lit(0), F.lit(months)))
    else:
        width = n * DAYS[unit] if day else (n * 24 * DAYS.get(unit, 0) or n) * 3600 * 1_000_000
        far = at + F.lit(-width if trailing else width)
    near_out, far_out = (0, 1) if w.include_anchor else (1, 0)
    return (at, far + far_out, at - near_out) if trailing else (at, at + near_out, far - far_out)


def over_frame(cells: C.Cells, keys: Sequence[str], order: str, w: Window) -> C.Cells:
    """Cells with each mergeable part merged over the frame."""
    leaves = [i for i, leaf in enumerate(cells.leaves) if leaf.mergeable]
    if not leaves:
        return cells
    by_day = dict(cells.df.dtypes)[order] == "date"
    if w.normal_range == "cumulative":
        return _cumulative(cells, keys, order, leaves, by_day)
    if w.normal_range == "all":
        names = [n for i in leaves for n in cells.part_names(i).values()]
        cells = cells.settled()
        plain = C.replace(cells, leaves=tuple(cells.leaves[i] for i in leaves))
        return C.replace(cells, df=C.join_hot(cells.df.drop(*names), plain.regroup(keys).df, keys))
    side, n, unit = w.span
    if unit in MONTHS:
        frame = (keys, order, side, n * MONTHS[unit], w.include_anchor)
        extremes = [i for i in leaves if cells.leaves[i].fn in ("MIN", "MAX")]
        others = [i for i in leaves if i not in extremes]
        if others:
            cells = (_over_months if by_day else _over_month_timestamps)(cells, *frame, others)
        return _extremes_over_months(cells, *frame, extremes) if extremes else cells
    day = F.col(f"`{order}`")
    if not by_day or unit == "hour":
        micros = (n * 24 * DAYS.get(unit, 0) or n) * 3600 * 1_000_000
        at = F.unix_micros(day.cast("timestamp"))
        return _over_blocks(cells, keys, at, micros, side, w.include_anchor, leaves, spread=True)
    word = "PRECEDING" if side == "trailing" else "FOLLOWING"
    width = n * DAYS[unit]
    if width > SLIDING_DAYS:
        return _over_blocks(cells, keys, F.unix_date(day), width, side, w.include_anchor, leaves, spread=False)
    near = "CURRENT ROW" if w.include_anchor else f"{interval(1, 'day')} {word}"
    far = f"{interval(width - 1 if w.include_anchor else width, 'day')} {word}"
    bounds = f"{far} AND {near}" if side == "trailing" else f"{near} AND {far}"
    return cells.over(frame_text(keys, order, bounds), leaves)


def _cumulative(cells: C.Cells, keys: Sequence[str], order: str, leaves: list[int], by_day: bool) -> C.Cells:
    """Running values: one window per group over days, whose number the calendar bounds.

    Other order columns, such as raw timestamps, may have any number of members per group: the work
    is range-partitioned.
    """
    frame = frame_text(keys, order, "UNBOUNDED PRECEDING AND CURRENT ROW")
    if by_day:
        return cells.over(frame, leaves)
    cells = cells.settled()
    fns = {"s": "sum", "n": "sum", "lo": "min", "hi": "max"}
    parts = {n: (fns[p], n) for i in leaves for p, n in cells.part_names(i).items()}
    return C.replace(cells, df=S.running(cells.df, list(keys), order, parts))


def _over_blocks(
    cells: C.Cells, keys: Sequence[str], at: Column, span: int, side: str, anchor: bool, leaves: list[int], spread: bool
) -> C.Cells:
    """Frames of a fixed length on an axis of whole numbers (days, microseconds)."""
    first = {("trailing", False): -span, ("trailing", True): 1 - span, ("leading", False): 1, ("leading", True): 0}
    at = at.cast("bigint")
    return _over_spans(cells, keys, at, [at + F.lit(first[side, anchor])], span, leaves, spread)


def _over_spans(
    cells: C.Cells, keys: Sequence[str], at: Column, lows: list[Column], span: int, leaves: list[int], spread: bool
) -> C.Cells:
    """Frames made of stretches of one length, `span`, that begin at `lows`.

    The axis is cut into blocks as long as a stretch, so a stretch is the end of one block and the
    beginning of the next. Every anchor asks both blocks, and running values from either end of a
    block answer: the work per row does not depend on how many rows a frame holds. A group of any
    size is spread over its blocks, and with `spread`, where a block may hold any number of rows, a
    block over ranges.
    """
    at, width = at.cast("bigint"), F.lit(span).cast("bigint")
    functions = {"s": "sum", "n": "sum", "lo": "min", "hi": "max"}
    parts = {n: functions[p] for i in leaves for p, n in cells.part_names(i).items()}
    types = dict(cells.df.dtypes)
    rest = [c for c in cells.df.columns if c not in parts]

    def row(kind: int, pos: Column, block: Column) -> Column:
        values = [(F.col(n) if kind == 0 else F.lit(None).cast(types[n])).alias(n) for n in parts]
        return F.struct(F.lit(kind).alias("__kind"), pos.alias("__pos"), block.alias("__block"), *values)

    start = lambda c: c - F.pmod(c, width)
    asks = [r for low in lows for r in (row(1, low, start(low)), row(2, low + width - 1, start(low) + width))]
    flat = cells.df.select(*columns(rest), F.inline(F.array(row(0, at, start(at)), *asks)))
    if spread:
        flat, grouped = S.settle(flat), [*keys, "__block"]
        running = {n: (fn, n) for n, fn in parts.items()}

        def answered(kind: int, sign: int) -> DataFrame:
            """What the rows at or before (for kind 2), at or after (kind 1) an ask's place in its block come to."""
            placed = flat.where(F.col("__kind").isin(0, kind)).withColumn("__pos", F.struct("__pos", sign * F.col("__kind")))
            return S.running(placed, grouped, "__pos", running, descending=kind == 1).where("__kind > 0")

        asked = answered(1, -1).unionByName(answered(2, 1))
    else:
        by_block = "PARTITION BY " + ", ".join(f"`{k}`" for k in [*keys, "__block"])
        upward = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        seen = {
            n: F.expr(
                f"CASE __kind WHEN 1 THEN {fn}({n}) OVER ({by_block} ORDER BY __pos DESC {upward}) "
                f"WHEN 2 THEN {fn}({n}) OVER ({by_block} ORDER BY __pos {upward}) END"
            )
            for n, fn in parts.items()
        }
        asked = flat.withColumns(seen).where("__kind > 0")
    merged = [F.expr(f"{fn}({n})").alias(n) for n, fn in parts.items()]
    return C.replace(cells, df=asked.groupBy(*columns(rest)).agg(*merged))


def _extremes_over_months(
    cells: C.Cells, keys: Sequence[str], order: str, side: str, months: int, anchor: bool, leaves: list[int]
) -> C.Cells:
    """Extremes over whole months before or after a date or timestamp.

    Months differ in length, but the shortest frame is longer than half the longest: two stretches of
    27 days a month, one from either end of a frame, cover it, and what both of them hold does not
    count twice in an extreme.
    """
    day = dict(cells.df.dtypes)[order] == "date"
    number = (lambda c: F.unix_date(c)) if day else (lambda c: F.unix_micros(c.cast("timestamp")))
    span = 27 * months * (1 if day else 24 * 3600 * 1_000_000)
    here = F.col(f"`{order}`")
    shift_by = F.lit(-months if side == "trailing" else months)
    far = F.add_months(here, shift_by) if day else F.expr(f"`{order}` {'-' if side == 'trailing' else '+'} INTERVAL '{months}' MONTH")
    near, away = number(here).cast("bigint"), number(far).cast("bigint")
    inner, outer = (0, 1) if anchor else (1, 0)  # what is left out at the anchor and at the far end
    low, high = (away + outer, near - inner) if side == "trailing" else (near + inner, away - outer)
    return _over_spans(cells, keys, number(here), [low, high - (span - 1)], span, leaves, spread=not day)


def _over_months(
    cells: C.Cells, keys: Sequence[str], order: str, side: str, months: int, anchor: bool, leaves: list[int]
) -> C.Cells:
    """Frames of whole months without the anchor's day, or without the day at their far end.

    A frame bound cannot mix months and days, so the closed frame is taken, and sums and counts are
    reduced by the one day.
    """
    edge = f"INTERVAL '{months}' MONTH {'PRECEDING' if side == 'trailing' else 'FOLLOWING'}"
    whole = f"{edge} AND CURRENT ROW" if side == "trailing" else f"CURRENT ROW AND {edge}"
    frame = frame_text(keys, order, whole)
    cut = frame_text(keys, order, f"{edge} AND {edge}" if anchor else "CURRENT ROW AND CURRENT ROW")
    cols = {}
    for i in leaves:
        for name in cells.part_names(i).values():
            total, inner = (F.expr(f"sum({name}) OVER ({f})") for f in (frame, cut))
            n, n_cut = (F.expr(f"count({name}) OVER ({f})") for f in (frame, cut))
            cols[name] = F.when(n > n_cut, total - F.coalesce(inner, F.lit(0)))
    return C.replace(cells, df=cells.df.withColumns(cols))


def _over_month_timestamps(
    cells: C.Cells, keys: Sequence[str], order: str, side: str, months: int, anchor: bool, leaves: list[int]
) -> C.Cells:
    """Frames of whole months before or after a timestamp, for sums and counts.

    A frame's value is the difference of two running values. Every anchor asks at both ends of its
    frame, before or after the rows of that very time; the running values are range-partitioned.
    """
    names = [n for i in leaves for n in cells.part_names(i).values()]
    types = dict(cells.df.dtypes)
    rest = [c for c in cells.df.columns if c not in names]
    day = F.col(f"`{order}`")
    far = F.expr(f"`{order}` {'-' if side == 'trailing' else '+'} INTERVAL '{months}' MONTH")
    low, high = (far, day) if side == "trailing" else (day, far)
    after = anchor if side == "trailing" else not anchor

    def row(kind: int, at: Column, sign: int) -> Column:
        values = [(F.col(n) if kind == 1 else F.lit(None).cast(types[n])).alias(f"v_{n}") for n in names]
        known = [(F.col(n).isNotNull().cast("bigint") if kind == 1 else F.lit(0).cast("bigint")).alias(f"k_{n}") for n in names]
        return F.struct(F.struct(at.alias("at"), F.lit(kind).alias("kind")).alias("__pos"), F.lit(sign).alias("__sign"), *values, *known)

    asks = 2 if after else 0
    flat = S.settle(cells.df.select(*columns(rest), F.inline(F.array(row(1, day, 0), row(asks, low, -1), row(asks, high, 1)))))
    parts = {f"{p}_{n}": ("sum", f"{p}_{n}") for n in names for p in "vk"}
    asked = S.running(flat, list(keys), "__pos", parts).where("__sign <> 0")
    signed = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("__sign"))
    merged = asked.groupBy(*columns(rest)).agg(*[F.when(signed(f"k_{n}") > 0, signed(f"v_{n}")).cast(types[n]).alias(n) for n in names])
    return C.replace(cells, df=merged)


def distinct_over(
    rows: DataFrame, anchors: DataFrame, keys: Sequence[str], order: str, w: Window
) -> DataFrame:
    """Distinct count of `__key` in the frame of every anchor (T6), as column `__count`.

    Each occurrence of a value covers a run of anchor dates, cut where the next occurrence takes
    over. Runs turn into +1 / -1 events; their running sum at an anchor is the count. The work is
    linear in the distinct (value, date) pairs, whatever the width of the frame.
    """
    d = F.col(f"`{order}`")
    part = columns(keys)
    if w.normal_range == "all":
        totals = rows.groupBy(*part).agg(F.count_distinct("__key").alias("__count"))
        return C.join_on(anchors, totals, list(keys))
    if not _by_day(w, dict(rows.dtypes)[order]):
        return _distinct_over_timestamps(rows, anchors, keys, order, w)
    if w.normal_range == "cumulative":
        runs = rows.groupBy(*part, "__key").agg(F.min(d).alias("__start")).withColumn("__end", F.lit(None).cast("date"))
    else:
        start, end = _run_of(d, W.partitionBy(*part, F.col("__key")).orderBy(d), w)
        runs = rows.select(*part, start.alias("__start"), end.alias("__end"))
    runs = runs.where("__start IS NOT NULL AND (__end IS NULL OR __start <= __end)")
    events = runs.select(
        *part,
        F.inline(
            F.array(
                F.struct(F.col("__start").alias("__day"), F.lit(1).alias("__delta")),
                F.struct(F.date_add("__end", 1).alias("__day"), F.lit(-1).alias("__delta")),
            )
        ),
    )
    return running_count(events.where("__day IS NOT NULL"), anchors, keys, order)


def _distinct_over_timestamps(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], order: str, w: Window) -> DataFrame:
    """`distinct_over` on an axis of microseconds.

    An anchor counts a value if its nearest occurrence lies in the frame. So an occurrence answers
    the anchors between itself and its neighbour, and among them the stretches `_reach` gives. The
    neighbours are found by ranges: one value may have any number of occurrences.
    """
    trailing = w.span[0] == "trailing"
    part, t = columns(keys), F.col("__ts")
    placed = rows.select(*part, "__key", F.col(f"`{order}`").cast("timestamp").alias("__ts")).where("__ts IS NOT NULL")
    known = S.neighbours(placed, [*keys, "__key"], "__ts", "__near", ahead=trailing)
    here, near = F.unix_micros(t), F.unix_micros("__near")
    own = int(not w.include_anchor)
    if trailing:
        low, high = here + own, near + (own - 1)
    else:
        low, high = near + (1 - own), here - own
    stretches = F.transform(_reach(t, w), lambda s: F.struct(F.greatest(low, s["low"]).alias("__start"), F.least(high, s["high"]).alias("__end")))
    runs = known.select(*part, F.inline(stretches)).where("__start <= __end")
    event = lambda day, delta: F.struct(day.alias("__day"), F.lit(delta).alias("__delta"))
    events = runs.select(*part, F.inline(F.array(event(F.col("__start"), 1), event(F.col("__end") + 1, -1))))
    at = F.unix_micros(F.col(f"`{order}`").cast("timestamp"))
    counted = running_count(events, anchors.withColumn(order, at), keys, order)
    kind = dict(anchors.dtypes)[order]
    return counted.withColumn(order, F.timestamp_micros(F.col(f"`{order}`")).cast(kind))


def _reach(t: Column, w: Window) -> Column:
    """Stretches of anchors whose frame reaches `t` at its far end, in microseconds, as an array of (low, high).

    Months clamp: the 28th to 31st of March less a month are all the 28th of February, each at its
    own time of day. Anchors on days that meet the day of `t` reach it up to (leading: from) its time
    of day, so every such day is a stretch; all other days reach it whole or not at all.
    """
    side, n, unit = w.span
    here, open_end = F.unix_micros(t), int(w.include_anchor)
    stretch = lambda low, high: F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    if unit not in MONTHS:
        width = F.lit((n * 24 * DAYS.get(unit, 0) or n) * 3600 * 1_000_000)
        if side == "trailing":
            return F.array(stretch(F.lit(None), here + width - open_end))
        return F.array(stretch(here - width + open_end, F.lit(None)))
    day = t.cast("date")
    begin = lambda d: F.unix_micros(d.cast("timestamp"))
    same_time = lambda d: F.unix_micros(t + F.make_interval(days=F.date_diff(d, day)))
    days = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    if side == "trailing":
        whole, last = _last_anchor(F.date_sub(day, 1), n, unit), _last_anchor(day, n, unit)
        met = F.transform(days(F.date_add(whole, 1), last), lambda d: stretch(begin(d), same_time(d) - open_end))
        return F.concat(F.array(stretch(F.lit(None), begin(F.date_add(whole, 1)) - 1)), met)
    whole, first = _first_anchor(F.date_add(day, 1), n, unit), _first_anchor(day, n, unit)
    met = F.transform(days(first, F.date_sub(whole, 1)), lambda d: stretch(same_time(d) + open_end, begin(F.date_add(d, 1)) - 1))
    return F.concat(F.array(stretch(begin(whole), F.lit(None))), met)


def _last_anchor(d: Column, n: int, unit: str) -> Column:
    """Latest anchor whose trailing frame still reaches back to `d`."""
    end = shift(d, n, unit)
    return F.when(d == F.last_day(d), F.last_day(end)).otherwise(end) if unit in MONTHS else end


def _first_anchor(d: Column, n: int, unit: str) -> Column:
    """Earliest anchor whose leading frame reaches up to `d`."""
    start = shift(d, -n, unit)
    return F.when(shift(start, n, unit) < d, F.date_add(start, 1)).otherwise(start)


def running_count(
    events: DataFrame, anchors: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Running sum of events at the anchor dates. Events are summed per day before the window."""
    part = columns(keys)
    marked = events.select(*part, F.col("__day"), F.col("__delta"), F.lit(0).alias("__anchor")).unionByName(
        anchors.select(
            *part, F.col(f"`{order}`").alias("__day"), F.lit(0).alias("__delta"), F.lit(1).alias("__anchor")
        )
    )
    daily = marked.groupBy(*part, F.col("__day")).agg(
        F.sum("__delta").alias("__delta"), F.max("__anchor").alias("__anchor")
    )
    counted = _running_sum(daily, keys, "__count").where("__anchor = 1")
    return counted.select(*part, F.col("__day").alias(order), "__count")


def _running_sum(daily: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Running sum of the events: a window over days, else by range as in `_cumulative`."""
    if dict(daily.dtypes)["__day"] == "date":
        order = W.partitionBy(*columns(keys)).orderBy("__day").rowsBetween(W.unboundedPreceding, 0)
        return daily.withColumn(out, F.sum("__delta").over(order))
    return S.running(daily, list(keys), "__day", {out: ("sum", "__delta")})
