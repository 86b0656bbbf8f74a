"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell, a combination of values of the dimensions (source,
language, topic). A cell's expected number of draws of each of its documents
starts at the share of the tokens that is to be drawn and is raked: in each
sweep, for one dimension after the other, it is scaled so that the expected
tokens of each value are the value's target. Sweeps go on until every target is
met to ``TOLERANCE``, or ``MAX_SWEEPS``. Documents are then drawn by a hash of
their id.

A document is drawn once at most (``repeats=False``): raking and the bound work
together, a cell at the bound stays there while the others of its value make up
for it. A value whose target is more than there is of it gives all it has, and
the rest goes to the other values in proportion (``target_masses``); targets
that are feasible one by one but not together are met as far as the sweeps come.
``margins`` shows wanted, feasible and expected shares. With ``repeats=True``
there is no bound, and ``copies`` takes documents several times.

All steps are DataFrame functions. Documents are counted into cells before
anything is shuffled, so a source that holds a third of them is no hot key; the
cells carry everything else, and meet the documents again by broadcast, which
is done only below a checked number of cells (beyond it by a join on cell and
salt).

Defined cases: nulls in a dimension count as the empty value; null and empty
texts have no tokens and are drawn with their cell's probability; rows that
repeat an id are drawn together; a null id counts as an empty one; targets for
values that do not occur are ignored and the rest scaled to 1; values without a
target keep their present share of what the targets leave; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, fresh, text_of, with_out

#: Sweeps over all dimensions: at most, and between two looks at the targets.
MAX_SWEEPS, SWEEPS = 48, 6
#: Share of all that is drawn by which a value may miss its target.
TOLERANCE = 1e-12
#: Cells that may be broadcast; beyond them documents and cells meet by a salted join.
MAX_BROADCAST_CELLS, SALTS = 100_000, 64
#: Cells up to which sums are taken by windows; beyond them by aggregation and join.
MAX_WINDOW_CELLS = 100_000
#: Bits of the hash that a document is drawn by.
DRAW_BITS = 52


def token_count(text: Column) -> Column:
    """Words, parted by white space."""
    return F.size(F.filter(F.split(text, SPACE_CLASS), lambda w: w != F.lit(""))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic, by the form of the text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.rlike(text, F.lit("[#$%&*!]{2}")), "noise")
        .when(F.length(text) < 600, "note")
        .otherwise("prose")
    )


def draw_of(id_col: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long") / float(1 << DRAW_BITS)


def target_shares(cells: DataFrame, dim: str, target: dict[str, float] | float) -> DataFrame:
    """Rows (dim, share). A number as target is the power that the present shares are raised to: below 1 it lifts the small ones."""
    now = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if isinstance(target, dict):
        known = F.create_map(*(F.lit(x) for v, s in target.items() for x in (v, float(s))))
        left = max(0.0, 1.0 - sum(target.values()))
        free = F.element_at(known, F.col(dim)).isNull()
        total = now.agg(F.sum(F.when(free, F.col("tokens")).otherwise(0)).alias("free"))
        raw = now.crossJoin(F.broadcast(total)).select(dim, F.coalesce(F.element_at(known, F.col(dim)), F.col("tokens") / F.col("free") * left).alias("raw"))
    else:
        raw = now.select(dim, F.pow(F.col("tokens").cast("double"), F.lit(float(target))).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select(dim, (F.col("raw") / F.col("all")).alias("share"))


def target_masses(cells: DataFrame, dim: str, target: dict[str, float] | float, drawn: float, repeats: bool) -> DataFrame:
    """Rows (dim, share, mass): the wanted share, and the tokens that are to be drawn of ``drawn`` in all.

    Without repeats a value gives what it has at most. The others share the
    rest: the level that all can rise to is the greatest of those reached as
    values are taken in the order in which they run out.
    """
    shares = target_shares(cells, dim, target)
    if repeats:
        return shares.withColumn("mass", F.col("share") * float(drawn))
    there = cells.groupBy(dim).agg(F.sum("tokens").alias("there"))
    by = Window.orderBy(F.col("there") / F.col("share"), dim)  # one row for each value of a dimension
    before = lambda c: F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("share").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(drawn)) - F.coalesce(before("there"), F.lit(0))) / after
    levels = shares.where("share > 0").join(there, dim).withColumn("level", level)
    most = F.max("level").over(Window.partitionBy())
    return levels.select(dim, "share", F.least(F.col("there").cast("double"), F.col("share") * most).alias("mass"))


def _step(expected: Column, tokens: Column, mass: Column, now: Column, full: Column) -> Column:
    """A cell's expected draws once its value's tokens (``now``, of which ``full`` in cells at the bound) are scaled to ``mass``."""
    more = F.least(F.lit(1.0), expected * (mass - full) / (now - full))
    return F.when(mass.isNull() | (now <= 0), expected).when(now > mass, expected * mass / now).when((expected < 1) & (now > full), more).otherwise(expected)


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], share: float, repeats: bool = False, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """``cells`` (the dimensions and tokens) with ``expected``, the number of times that each document of a cell is to be drawn.

    Up to MAX_WINDOW_CELLS cells the sweeps between two looks at the targets are
    one chain of window sums in one task, without a shuffle. Beyond that, sums
    are aggregated before they are shuffled and joined back. All is written to
    the checkpoint folder in between.
    """
    dims = list(targets)
    totals = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    drawn = share * (totals["tokens"] or 0)
    now = cells.withColumn("expected", F.lit(float(share)))
    if not drawn:
        return now
    masses = {d: cut(target_masses(cells, d, targets[d], drawn, repeats).select(d, F.col("mass").alias(f"__mass_{d}"))) for d in dims}
    for d in dims:
        now = now.join(masses[d], d, "left")
    together = (lambda df: cut(df).coalesce(1)) if totals["cells"] <= MAX_WINDOW_CELLS else cut
    now = together(now)
    weighed, bound = F.col("expected") * F.col("tokens"), F.col("expected") >= (float("inf") if repeats else 1.0)
    whole = F.when(bound, F.col("tokens").cast("double")).otherwise(0.0)
    for sweep in range(max_sweeps):
        for d in dims:
            if totals["cells"] <= MAX_WINDOW_CELLS:
                by = Window.partitionBy(d)
                sums = (F.sum(weighed).over(by), F.sum(whole).over(by))
            else:
                own = now.groupBy(d).agg(F.sum(weighed).alias("__now"), F.sum(whole).alias("__full"))
                now, sums = now.join(own, d), (F.col("__now"), F.col("__full"))
            made = _step(F.col("expected"), F.col("tokens"), F.col(f"__mass_{d}"), *sums) if not repeats else F.when(F.col(f"__mass_{d}").isNotNull() & (sums[0] > 0), F.col("expected") * F.col(f"__mass_{d}") / sums[0]).otherwise(F.col("expected"))
            now = now.withColumn("expected", made).drop("__now", "__full")
        last = sweep + 1 == max_sweeps
        if totals["cells"] > MAX_WINDOW_CELLS or (sweep + 1) % SWEEPS == 0 or last:
            now = together(now)
        if (sweep + 1) % SWEEPS == 0 and not last:
            off = [now.groupBy(d).agg(F.abs(F.sum(weighed) - F.first(f"__mass_{d}")).alias("off")).agg(F.max("off").alias("off")) for d in dims]
            worst = off[0]
            for x in off[1:]:
                worst = worst.union(x)
            if worst.agg(F.max("off")).first()[0] <= TOLERANCE * drawn:
                break
    return now.select(*cells.columns, "expected")


def margins(fitted: DataFrame, targets: dict[str, dict[str, float] | float], share: float, repeats: bool = False) -> DataFrame:
    """Rows (dimension, value, wanted, feasible, expected): shares of the tokens drawn, by the cells that ``rake`` gives."""
    drawn = share * (fitted.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    out = None
    for d, target in targets.items():
        got = fitted.groupBy(d).agg((F.sum(F.col("expected") * F.col("tokens")) / drawn).alias("expected"))
        own = target_masses(fitted, d, target, drawn, repeats).join(got, d).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col("share").alias("wanted"), (F.col("mass") / drawn).alias("feasible"), "expected")
        out = own if out is None else out.union(own)
    return out


def cells_of(docs: DataFrame, targets: dict, text_col: str = "text", topic: Column | None = None) -> tuple[DataFrame, dict[str, str], str]:
    """``docs`` with a column for each dimension's value and one for its tokens; the names of these."""
    text, tokens = fresh(docs, "text", "tokens")
    dims = {d: fresh(docs, f"dim_{d}")[0] for d in targets}
    df = docs.withColumn(text, text_of(text_col))
    values = {d: (topic if topic is not None else topic_of(F.col(text))) if d == "topic" else F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dims}
    return df.withColumns({tokens: token_count(F.col(text))} | {dims[d]: v for d, v in values.items()}).drop(text), dims, tokens


def fit(docs: DataFrame, targets: dict[str, dict[str, float] | float], share: float, text_col: str = "text", topic: Column | None = None, repeats: bool = False, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """The raked cells of ``docs``: the dimensions, tokens and expected."""
    df, dims, tokens = cells_of(docs, targets, text_col, topic)
    cells = cut(df.groupBy(*(F.col(dims[d]).alias(d) for d in dims)).agg(F.sum(tokens).alias("tokens")))
    return cut(rake(cells, targets, share, repeats, max_sweeps))


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | float], share: float, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, seed: str = "mix", repeats: bool = False, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """The rows and columns of ``docs`` with a struct column ``mix``: the dimensions, tokens, weight, probability, sampled, copies.

    ``targets`` maps dimensions (columns of ``docs``, or "topic") to target
    shares by value, or to a power; see ``target_shares``. ``weight`` is the
    expected number of draws against an even draw of ``share``; ``probability``
    that of at least one draw; ``copies`` the number of draws.
    """
    fitted = fit(docs, targets, share, text_col, topic, repeats, max_sweeps)
    df, dims, tokens = cells_of(docs, targets, text_col, topic)
    expected, salt = fresh(df, "expected", "salt")
    # to 9 decimals, so that the order in which sums are added does not show
    small = fitted.select(*(F.col(d).alias(dims[d]) for d in dims), F.round("expected", 9).alias(expected))
    if fitted.count() <= MAX_BROADCAST_CELLS:
        met = df.join(F.broadcast(small), list(dims.values()), "left")
    else:
        spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = df.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(spread, [*dims.values(), salt], "left")
    draw, own = draw_of(F.col(id_col), seed), F.col(expected)
    out = F.struct(
        *(F.col(dims[d]).alias(d) for d in dims),
        F.col(tokens).alias("tokens"),
        (own / float(share or 1)).alias("weight"),
        F.least(F.lit(1.0), own).alias("probability"),
        (draw < own).alias("sampled"),
        (F.floor(own) + (draw < own - F.floor(own)).cast("long")).alias("copies"),
    )
    return met.withColumn("mix", out).select(*with_out(docs, "mix"))
