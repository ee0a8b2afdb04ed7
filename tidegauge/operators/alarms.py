"""Health roll-ups, states by precedence, alarms with hysteresis and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ordinals of the badge, from 0. Compared as numbers, never as labels.
HEALTH = ["healthy", "warning", "error", "critical"]


def _reason(when: Column, code: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(HEALTH.index(severity)).alias("severity"), F.lit(code).alias("code")))


def health(flows: DataFrame) -> DataFrame:
    """H1, O1: ``flows`` with reasons (the worst first, else in the order of the rules) and health, the
    worst reason's label.

    Columns read: bps, lost, sync_losses, p1_ok, p2_ok, exceeded, blocked, slots, stalled. Null
    counts as nothing wrong, except that a null rate is no data."""
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("bps", "lost", "sync_losses", "slots", "stalled")}
    c |= {n: F.coalesce(F.col(n), F.lit(n.endswith("_ok"))) for n in ("p1_ok", "p2_ok", "exceeded", "blocked")}
    synced, all_stalled = c["sync_losses"] == 0, (c["slots"] > 0) & (c["stalled"] >= c["slots"])
    rules = [
        _reason(~synced, "tr101290_sync_loss", "critical"),
        _reason(synced & ~c["p1_ok"], "tr101290_p1", "error"),
        _reason((c["bps"] == 0) & ~c["blocked"], "no_data", "critical"),
        _reason(c["blocked"], "bandwidth_blocked", "error"),
        _reason(c["exceeded"] & ~c["blocked"], "bandwidth_exceeded", "warning"),
        _reason(c["lost"] > 100, "packet_loss_high", "error"),
        _reason(c["lost"].between(1, 100), "packet_loss", "warning"),
        _reason(all_stalled, "assembly_all_stalled", "error"),
        _reason((c["stalled"] > 0) & ~all_stalled, "assembly_slot_stalled", "warning"),
        _reason(~c["p2_ok"], "tr101290_p2", "warning"),
    ]
    placed = F.transform(F.array_compact(F.array(*rules)), lambda r, i: F.struct((-r["severity"]).alias("rank"), i.alias("place"), r["code"].alias("code")))
    ranked = flows.withColumn("reasons", F.array_sort(placed))
    worst = -F.coalesce(F.get("reasons", F.lit(0))["rank"], F.lit(0))
    return ranked.withColumn("health", F.element_at(F.array(*map(F.lit, HEALTH)), worst + 1)).withColumn("reasons", F.transform("reasons", lambda r: r["code"]))


def input_state(bps: Column, packets: Column, failed: Column) -> Column:
    """H2."""
    return F.when(bps > 0, "receiving").when(failed, "connect_failed").when(packets > 0, "idle").otherwise("waiting")


def output_state(bps: Column, sent: Column, dropped: Column, failed: Column, shown: Column | None = None, advancing: Column | None = None) -> Column:
    """H3; ``shown`` and ``advancing`` are a display's frames and whether they still come."""
    shown, advancing = F.lit(0) if shown is None else shown, F.lit(False) if advancing is None else advancing
    return F.when((bps > 0) | advancing, "active").when(failed, "connect_failed").when((sent > 0) | (shown > 0), "idle").when(dropped > 0, "dropping").otherwise("waiting")


def stalls(rows: DataFrame, keys: list[str], time: str, units: int = 5, unit_us: int = 1_000_000) -> DataFrame:
    """H4: runs of ``units`` and more seconds (or spans of ``unit_us``) without a packet between two with
    one: (keys, begin, alarm_at, resumed_at, n). A gap is one row however long it is."""
    seen = rows.select(*keys, F.floor(F.col(time) / unit_us).alias("_at")).distinct()
    gaps = seen.withColumn("_next", F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at"))).withColumn("n", F.col("_next") - F.col("_at") - 1)
    return gaps.where(F.col("n") >= units).select(*keys, (F.col("_at") + 1).alias("begin"), (F.col("_at") + units).alias("alarm_at"), F.col("_next").alias("resumed_at"), "n")


class Escalation:
    """H5: a higher level is entered with the ``grace``-th sample in a row above the present one, lower
    levels at once. States are 0 normal, 1 warning and 2 critical; a limit itself counts."""

    def __init__(self, warning: float, critical: float, grace: int):
        self.limits, self.grace, self.state, self.seen = (warning, critical), grace, 0, 0

    def add(self, value: float) -> int:
        level = sum(value >= x for x in self.limits)
        self.seen = self.seen + 1 if level > self.state else 0
        if level < self.state or self.seen >= self.grace:
            self.state, self.seen = level, 0
        return self.state


class Hysteresis:
    """On with the ``polls``-th value in a row above ``enter``, off with the first below
    ``leave`` (at it too, if ``inclusive``). A null value switches it off, or, if it is to be ``kept``
    (H6), changes nothing; no limit switches it off.

    H13 is Hysteresis(limit, limit - limit // 5, inclusive=True)."""

    def __init__(self, enter: float, leave: float, polls: int = 1, inclusive: bool = False, kept: bool = False):
        self.enter, self.leave, self.polls, self.inclusive, self.kept, self.on, self.run = enter, leave, polls, inclusive, kept, False, 0

    def add(self, value: float | None) -> bool:
        missing = value is None or value != value
        if missing and self.kept:
            return self.on
        if missing or self.enter <= 0:
            self.on, self.run = False, 0
            return False
        self.run = self.run + 1 if value > self.enter else 0
        if self.on and (value < self.leave or self.inclusive and value == self.leave):
            self.on = False
        elif self.run >= self.polls:
            self.on = True
        return self.on


def marked_transitions(rows: DataFrame, order: list[str], mark: Column) -> DataFrame:
    """(flow_id, event_id, state) at each row that changes the state, which is the last
    ``mark`` (1 on, 0 off, null: as it was); off before the first."""
    w = Window.partitionBy("flow_id").orderBy(*order)
    state = F.coalesce(F.last("_mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    held = rows.withColumn("_mark", mark).withColumn("state", state.cast("int")).withColumn("_before", F.coalesce(F.lag("state").over(w), F.lit(0)))
    return held.where("state != _before").select("flow_id", "event_id", "state")


def hysteresis_mark(value: Column, enter: float, leave: float, order: list[str], polls: int = 1, inclusive: bool = False, kept: bool = False) -> Column:
    """``Hysteresis`` as a mark: on with the ``polls``-th value in a row above ``enter``."""
    w = Window.partitionBy("flow_id").orderBy(*order)
    above = F.coalesce(value > enter, F.lit(False))
    for back in range(1, polls):
        above = above & F.coalesce(F.lag(value, back).over(w) > enter, F.lit(False))
    below = value <= leave if inclusive else value < leave
    gone = F.lit(None) if kept else F.when(value.isNull(), 0)
    return F.when(below, 0).when(above, 1).otherwise(gone)


#: Port states of a clock that follows none as it is the master, and of one that follows. Fixed values.
MASTER, SLAVE = 6, 9


def clock_states(rows: DataFrame, keys: list[str], order: list[str], port: str, offset: str, tolerance: int) -> DataFrame:
    """``rows`` with state: unknown without a port state, master, acquiring in any other port state but
    that of a slave. A slave is locked within the tolerance and else in holdover; one that was locked the row
    before leaves only beyond one and a half times the tolerance.

    Among rows of a slave in a row, what is within the tolerance or beyond the wider limit decides at
    once, the first row by the tolerance alone, and what lies between stays as it was."""
    w = Window.partitionBy(*keys).orderBy(*order)
    size, slave = F.abs(F.col(offset)), F.coalesce(F.col(port) == SLAVE, F.lit(False))
    begins = slave & ~F.coalesce(F.lag(slave).over(w), F.lit(False))
    plain = F.when(size <= tolerance, "locked").otherwise("holdover")
    mark = F.when(begins | (size <= tolerance) | (size > tolerance * 3 // 2), plain)
    held = rows.withColumns({"_m": F.when(slave, mark), "_r": F.sum(begins.cast("long")).over(w)})
    last = F.last("_m", True).over(Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col(port).isNull(), "unknown").when(F.col(port) == MASTER, "master").when(slave, last).otherwise("acquiring")
    return held.withColumn("state", state).drop("_m", "_r")


def transitions(rows: DataFrame, order: list[str], value: str, start, schema_key: str = "flow_id") -> DataFrame:
    """(key, event_id, state) at each row that changes the state that ``start()``'s add(value) gives."""
    from .fold import ordered_fold

    def step(s: list, r) -> list[tuple]:
        now = int(s[0].add(getattr(r, value)))
        changed, s[1] = now != s[1], now
        return [(getattr(r, schema_key), r.event_id, now)] if changed else []

    return ordered_fold(rows.select(schema_key, *order, value), [schema_key], order, lambda: [start(), 0], step, f"{schema_key} long, event_id long, state int")


def frozen(frames: DataFrame, keys: list[str], order: str, content: str, interval: int, dark: Column) -> DataFrame:
    """H7: frames at which the picture has been the same for ceil(30 / interval), two at least; a black
    picture is reported as black instead. (keys, order, verdict)."""
    need = max(2, -(-30 // interval))
    w = Window.partitionBy(*keys).orderBy(order)
    hashed = frames.withColumn("_h", F.xxhash64(content)).withColumn("_new", F.coalesce(F.col("_h") != F.lag("_h").over(w), F.lit(True)).cast("int"))
    runs = hashed.withColumn("_run", F.sum("_new").over(w))
    nth = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    verdict = F.when(dark, "black").when(F.col("_n") >= need, "frozen")
    return runs.withColumn("_n", nth).select(*keys, order, verdict.alias("verdict")).where("verdict IS NOT NULL")


def bars(rsrp: Column, sinr: Column, rssi: Column) -> Column:
    """H9: signal bars, the fewest that any of the measures gives; rssi counts only without rsrp.
    Fixed values."""
    def level(v: Column, least: list[int]) -> Column:
        steps = F.when(v >= least[0], 5)
        for i, x in enumerate(least[1:], 1):
            steps = steps.when(v >= x, 5 - i)
        return F.when(v.isNotNull(), steps.otherwise(0))

    weak = F.when(rsrp.isNull(), level(rssi, [-65, -75, -85, -95, -105]))
    return F.least(level(rsrp, [-80, -90, -100, -105, -115]), level(sinr, [20, 13, 6, 0, -5]), weak)


def armed(rows: DataFrame, commands: DataFrame, pre_us: int) -> DataFrame:
    """Rows with the mode that the last command (flow_id, at_us, armed) put in force: armed, prebuffer
    (not armed, but within ``pre_us`` of the next arming), else idle."""
    c = commands.select("flow_id", F.col("at_us").alias("t"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("event_id"), F.col("armed").alias("a"))
    r = rows.select("flow_id", F.col("recv_us").alias("t"), F.lit(1).alias("what"), "event_id", F.lit(None).cast("boolean").alias("a"))
    w = Window.partitionBy("flow_id").orderBy("t", "what", "event_id")
    on = F.coalesce(F.last("a", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    back = Window.partitionBy("flow_id").orderBy(F.desc("t"), F.desc("what"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    arming = F.last(F.when(F.col("a"), F.col("t")), True).over(back)
    soon = F.coalesce(arming - F.col("t") <= pre_us, F.lit(False))
    mode = F.when(F.col("_on"), "armed").when(F.col("_soon"), "prebuffer").otherwise("idle")
    return c.unionAll(r).withColumns({"_on": on, "_soon": soon}).where("what = 1").select("flow_id", "event_id", mode.alias("mode"))


def boundaries(items: DataFrame, keys: list[str], order: str, ready: Column, contract: list[str], normalised: bool = False) -> DataFrame:
    """How each playlist item meets the next, the last one the first: unsupported if either can't
    be played, native_continuous if all columns of ``contract`` agree, else native_discontinuity
    (normalise_required whatever agrees, if the output is ``normalised``); reasons: what differs."""
    w = Window.partitionBy(*keys).orderBy(order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(everything))
    met = items.withColumn("_ok", ready).withColumns({"_next": after(F.struct("_ok", *contract))})
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_next.{c}")), F.lit(c)) for c in contract]))
    other = F.lit("normalise_required") if normalised else F.when(F.size("reasons") == 0, "native_continuous").otherwise("native_discontinuity")
    judged = met.withColumn("reasons", differ).withColumn("boundary", F.when(F.col("_ok") & F.col("_next._ok"), other).otherwise("unsupported"))
    return judged.drop("_ok", "_next")


def down_for(changes: DataFrame, keys: list[str], at: str, up: str, now: Column) -> DataFrame:
    """(keys, down_us): how long the link has been down since it last went down; null if it is up."""
    last_up = F.max(F.when(F.col(up), F.col(at)))
    since = changes.join(changes.groupBy(*keys).agg(last_up.alias("_u")), keys).where(F.col("_u").isNull() | (F.col(at) > F.col("_u")))
    down = since.groupBy(*keys).agg((now - F.min(at)).alias("down_us"))
    return changes.select(*keys).distinct().join(down, keys, "left")


def paint_order(tiles: DataFrame, board: str) -> DataFrame:
    """O3: place of each tile from back to front."""
    return tiles.withColumn("place", F.row_number().over(Window.partitionBy(board).orderBy("z", "tile_id")))


def first_few(names: Column, most: int = 4) -> Column:
    """O2: the first names of a list, for a message."""
    return F.array_join(F.slice(names, 1, most), ", ")
