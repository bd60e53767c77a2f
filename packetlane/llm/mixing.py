"""Operator 9: mixing sources to target weights, in DataFrame functions only.

Documents are summed to cells of (source, language, topic). Iterative proportional fitting then finds one
factor for each value of each dimension, so that token weights times factors meet the target share of
every source, language and topic at once. A document's probability is its cell's factor, scaled so that the
mean number of tokens kept is BUDGET of all (no probability above 1: what is cut off there goes into
`weight`), and a document is kept if a hash of its id falls below it. Callers that keep no weights ask for `bounded`:
then probabilities of at most 1 meet budget and targets themselves, wherever there are tokens enough (see `bounded_rates`).

Only cells and factors take part in the rounds: sums are pre-aggregated, so a source with any share of the
rows is no hot group. Cases: a null source, language or topic is a value of its own, NULL_VALUE; null and empty
texts have no tokens, belong to a cell, and have the probability of that cell; values without a target keep their
observed share; an empty table gives an empty result; columns that clash with the new names are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.llm.store import written

ROUNDS = 8
#: Rounds with the bound inside, which settle slower.
BOUNDED_ROUNDS = 12
#: Target shares are observed shares to this power, made to sum to 1, where the caller names none.
SMOOTHING = 0.7
BUDGET = 0.5
NULL_VALUE = "(null)"


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: licence lines, symbols, then length."""
    return F.when(F.contains(text, F.lit("Licensed under")) | F.contains(text, F.lit("Copyright")), "legal").when(F.contains(text, F.lit("$$$")) | F.contains(text, F.lit("%%%")), "noise").when(tokens >= 1000, "long").when(tokens >= 200, "medium").otherwise("short")


def goals(cells: DataFrame, dims: list[str], targets: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """A table (value, seen, goal) for each dimension: its tokens and the share it shall have."""
    goal = {}
    for d in dims:
        seen = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("seen"))
        if targets and d in targets:
            named = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]) if targets[d] else F.lit(None).cast("map<string,double>")
            rest = cells.agg(F.sum("tokens").alias("all"))
            seen = seen.crossJoin(F.broadcast(rest)).withColumn("share", F.coalesce(F.try_element_at(named, F.col(d)), F.col("seen") / F.col("all")))
        else:
            seen = seen.withColumn("share", F.pow("seen", SMOOTHING))
        total = seen.agg(F.sum("share").alias("all_shares"))  # one row
        goal[d] = seen.crossJoin(F.broadcast(total)).select(d, "seen", (F.col("share") / F.nullif("all_shares", F.lit(0))).alias("goal"))
    return goal


def fit(cells: DataFrame, dims: list[str], targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """A table (value, factor) for each dimension. cells: the dimensions and `tokens`, one row for each cell."""
    goal = {d: written(g.select(d, "goal", F.lit(1.0).alias(f"f_{d}"))) for d, g in goals(cells, dims, targets).items()}
    for _ in range(rounds):
        for d in dims:
            others = reduce(lambda t, o: t.join(goal[o].select(o, f"f_{o}"), o), [o for o in dims if o != d], cells)
            has = others.groupBy(d).agg(F.sum(reduce(lambda a, o: a * F.col(f"f_{o}"), [o for o in dims if o != d], F.col("tokens").cast("double"))).alias("has"))
            goal[d] = written(goal[d].drop(f"f_{d}").join(has, d).withColumn(f"f_{d}", F.coalesce(F.try_divide("goal", "has"), F.lit(0.0))).select(d, "goal", f"f_{d}"))
    return goal


def level(rows: DataFrame, cap: Column, want: Column, total: float) -> float:
    """The factor at which the sum of least(cap, factor * want) is total; rows that reach their cap are held, the others rescaled."""
    at = 0.0
    while True:
        full = want * at >= cap
        held, free = rows.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(want))).first()
        new = (total - held) / free if free else at
        if new <= at * (1 + 1e-12):
            return at
        at = new


def bounded_rates(cells: DataFrame, dims: list[str], targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = BOUNDED_ROUNDS) -> DataFrame:
    """The dimensions and `probability`, at most 1: raking with the bound inside.

    A value with fewer tokens than its goal asks for is kept whole, and what it lacks goes to the other values of its
    dimension in proportion to their goals. In each round cells that reached 1 are held and the others of a value are
    rescaled to what is left of its goal; a cell that reached 1 may come down again. At last the budget is met exactly.
    """
    total = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    aim = {}
    for d, g in goals(cells, dims, targets).items():
        g = written(g)
        goal = F.coalesce("goal", F.lit(0.0))
        aim[d] = written(g.select(d, F.least("seen", goal * level(g, F.col("seen"), goal, total)).alias("aim")))
    n, rate = F.col("tokens").cast("double"), F.col("rate")
    rated = cells.select(*dims, "tokens", F.lit(float(budget)).alias("rate"))
    for _ in range(rounds):
        for d in dims:
            has = rated.groupBy(d).agg(F.sum(F.when(rate >= 1, n).otherwise(0.0)).alias("held"), F.sum(F.when(rate < 1, n * rate).otherwise(0.0)).alias("free"))
            held, free, want = F.col("held"), F.col("free"), F.col("aim")
            by = F.when((free == 0) & (want >= held * (1 - 1e-9)), 1.0).when((free > 0) & (want > held), (want - held) / free).otherwise(want / (held + free))
            rated = written(rated.join(has.join(aim[d], d).select(d, by.alias("by")), d).select(*dims, "tokens", (rate * F.col("by")).alias("rate")))
    return rated.select(*dims, F.least(F.lit(1.0), rate * (level(rated, n, n * rate, total) if total else 1.0)).alias("probability"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the id: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topics: Column | None = None, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int | None = None, bounded: bool = False, drop_text: bool = False) -> DataFrame:
    """Adds tokens, topic, probability, weight (1 if bounded) and sampled to every row. drop_text: without the text, which is then read once only."""
    new = ("tokens", "topic", "probability", "weight", "sampled")
    rest = [c for c in docs.columns if c not in new and not (drop_text and c == text)]
    dims = ["__source", "__lang", "__topic"]
    tagged = docs.select(
        *[docs[f"`{c}`"] for c in rest],
        docs[text].alias("__text"),
        n_tokens(docs[text]).alias("__tokens"),
        F.coalesce(docs[source].cast("string"), F.lit(NULL_VALUE)).alias("__source"),
        F.coalesce(docs[lang].cast("string"), F.lit(NULL_VALUE)).alias("__lang"),
    )
    tagged = tagged.withColumn("__topic", F.coalesce(topics, F.lit(NULL_VALUE)) if topics is not None else topic(F.col("__text"), F.col("__tokens"))).drop("__text")
    if drop_text:
        tagged = written(tagged.select(*rest, "__tokens", *dims))
    cells = written(tagged.groupBy(*dims).agg(F.sum("__tokens").alias("tokens")))
    named = {f"__{k}": v for k, v in targets.items()} if targets else None
    if bounded:
        rated = bounded_rates(cells, dims, named, budget, rounds or BOUNDED_ROUNDS).withColumn("weight", F.lit(1.0))
    else:
        goal = fit(cells, dims, named, rounds or ROUNDS)
        rated = cells
        for d in dims:
            rated = rated.join(goal[d].select(d, f"f_{d}"), d)
        rated = rated.withColumn("rate", reduce(lambda a, d: a * F.col(f"f_{d}"), dims[1:], F.col(f"f_{dims[0]}")))
        rated = written(rated.select(*dims, "tokens", "rate"))
        sums = rated.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("all_rates"))
        ideal = F.coalesce(F.try_divide(F.col("rate") * budget * F.col("all_tokens"), F.col("all_rates")), F.lit(0.0))
        rated = rated.crossJoin(F.broadcast(sums)).select(*dims, F.least(F.lit(1.0), ideal).alias("probability"), F.greatest(F.lit(1.0), ideal).alias("weight"))
    out = tagged.join(F.broadcast(written(rated)) if _small(cells) else written(rated), dims, "left")
    return out.select(*rest, F.col("__tokens").alias("tokens"), F.col("__topic").alias("topic"), "probability", "weight", (uniform(F.col(f"`{key}`")) < F.col("probability")).alias("sampled"))


def residuals(mixed: DataFrame, dim: str, targets: dict[str, float] | None = None) -> DataFrame:
    """value, goal, got, residual of one dimension of what `mix` gave: shares of the expected tokens, with their weights, against targets (else: smoothed observed shares)."""
    expected = F.sum(F.col("tokens") * F.col("probability") * F.col("weight"))
    got = mixed.groupBy(F.coalesce(F.col(dim).cast("string"), F.lit(NULL_VALUE)).alias(dim)).agg(F.sum("tokens").alias("tokens"), expected.alias("expected"))
    total = F.broadcast(got.agg(F.sum("expected").alias("total")))  # one row
    goal = goals(got, [dim], {dim: targets} if targets else None)[dim]
    share = F.coalesce(F.try_divide("expected", "total"), F.lit(0.0))
    return got.crossJoin(total).join(goal, dim).select(F.col(dim).alias("value"), "goal", share.alias("got"), F.abs(share - F.col("goal")).alias("residual"))


def _small(cells: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of cells may be broadcast: its rows are counted first; beyond that the join shuffles."""
    return cells.count() <= most


def sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The same for DuckDB, rounded to 6 places."""
    parts = [
        r"t AS (SELECT doc_id, coalesce(source, '(null)') AS s, coalesce(lang, '(null)') AS l, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents)",
        "u AS (SELECT doc_id, s, l, n, CASE WHEN contains(text, 'Licensed under') OR contains(text, 'Copyright') THEN 'legal' WHEN contains(text, '$$$') OR contains(text, '%%%') THEN 'noise' WHEN n >= 1000 THEN 'long' WHEN n >= 200 THEN 'medium' ELSE 'short' END AS t FROM t)",
        "c AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n FROM u GROUP BY ALL)",
    ]
    for d in "slt":
        parts.append(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(n), {SMOOTHING}) / sum(pow(sum(n), {SMOOTHING})) OVER () AS goal FROM c GROUP BY {d})")
        parts.append(f"f_{d}_0 AS (SELECT {d}, 1.0::DOUBLE AS f FROM g_{d})")
    at = dict.fromkeys("slt", 0)
    for r in range(1, rounds + 1):
        for d in "slt":
            a, b = [o for o in "slt" if o != d]
            at[d] = r
            parts.append(f"f_{d}_{r} AS MATERIALIZED (SELECT c.{d}, any_value(goal) / sum(c.n * x.f * y.f) AS f FROM c JOIN f_{a}_{at[a]} x ON x.{a} = c.{a} JOIN f_{b}_{at[b]} y ON y.{b} = c.{b} JOIN g_{d} g ON g.{d} = c.{d} GROUP BY c.{d})")
    parts.append(f"rate AS (SELECT c.s, c.l, c.t, c.n, x.f * y.f * z.f AS r FROM c JOIN f_s_{rounds} x ON x.s = c.s JOIN f_l_{rounds} y ON y.l = c.l JOIN f_t_{rounds} z ON z.t = c.t)")
    parts.append(f"p AS (SELECT s, l, t, r * {budget} * sum(n) OVER () / sum(n * r) OVER () AS ideal FROM rate)")
    return "WITH " + ", ".join(parts) + " SELECT doc_id, n AS tokens, t AS topic, round(least(1.0, ideal), 6) AS probability, round(greatest(1.0, ideal), 6) AS weight, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, ideal) AS sampled FROM u JOIN p USING (s, l, t)"
