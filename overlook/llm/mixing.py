"""Mixing sources to target weights: rake token weights to source, language and topic marginals, then sample.

The contingency table (source, language, topic) is aggregated once; proportional fitting runs on that table until the
marginals are met, and documents meet their calibrated probability in one join on the cell. The sample's size is a
parameter: cells in greater demand than they have tokens are taken whole, with a factor that says what is missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import free_names, table
from overlook.plans.shared import cut

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value is its token share to this power, scaled to 1: below 1 lifts small sources and languages.
TEMPERATURE = {"source": 0.7, "lang": 0.8, "topic": 0.95}
#: Proportional fitting stops when no marginal is further off than TOLERANCE, or after MAX_ROUNDS (targets that cannot be met).
TOLERANCE, MAX_ROUNDS = 1e-12, 500
#: Share of all tokens that the sample holds, as expected.
RATE = 0.5
SEED = "mix-1"
#: Cells (about 100 bytes each) up to which the table is fitted on the driver and the calibrated one is broadcast; beyond,
#: each step is a grouped sum over the table of cells.
SMALL_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A plain topic by the look of the whole text; the corpus has no topic column."""
    return (
        F.when(text.isNull(), "none").when(text.contains(" | "), "table").when(text.contains("icense"), "licence").when(text.contains("@"), "contact").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """White-space-parted words, counted without an array; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\t-\r ]+")).cast("long"), F.lit(0).cast("long"))


def tempered_targets(cells: DataFrame, temperature: dict[str, float] = TEMPERATURE) -> dict[str, DataFrame]:
    """For each dimension ``(value, target)``: shares of tokens, flattened by ``temperature``, that sum to 1."""
    out = {}
    for d, power in temperature.items():
        by = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(float(power))))
        whole = by.agg(F.sum("p")).first()[0] or 1.0
        out[d] = by.select(d, (F.col("p") / F.lit(whole)).alias("target"))
    return out


def _fit(tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], tolerance: float, max_rounds: int) -> tuple[np.ndarray, float]:
    """Weights of a small table by proportional fitting, and the largest difference from a target."""
    w = tokens / max(1.0, tokens.sum())
    residual = 1.0
    for _ in range(max_rounds):
        for c, t in zip(codes, wanted):
            s = np.bincount(c, w, len(t))
            w = w * np.divide(t, s, out=np.zeros_like(t), where=s > 0)[c]
        residual = max((float(np.abs(np.bincount(c, w, len(t)) - t).max(initial=0.0)) for c, t in zip(codes, wanted)), default=0.0)
        if residual <= tolerance:
            break
    return w, residual


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, small_cells: int = SMALL_CELLS) -> DataFrame:
    """Iterative proportional fitting of ``cells.tokens``: adds ``weight``, whose marginals meet the targets, and ``residual``.

    ``targets[d]`` has ``(d, target)``, shares that are scaled to 1 over the values that have tokens; a value without a
    target gets weight 0, as do empty cells. ``residual`` is the largest difference of a marginal from its target: above
    ``tolerance`` the targets contradict each other or the zeros of the table, and the weights are the last round's.
    """
    spark, dims = cells.sparkSession, list(targets)
    marks = {d: free_names(cells, f"target_{d}", f"sum_{d}") for d in dims}
    now = cells
    for d in dims:
        have = cells.where("tokens > 0").select(F.col(d).alias("v")).distinct()
        wanted = have.join(targets[d].select(F.col(d).alias("v"), F.col("target").cast("double").alias("t")).where("t > 0"), "v")
        whole = wanted.agg(F.sum("t")).first()[0] or 1.0
        now = now.join(wanted.select(F.col("v").alias(d), (F.col("t") / F.lit(whole)).alias(marks[d][0])), d, "left").fillna(0.0, [marks[d][0]])
    now = cut(now)
    if now.count() <= small_cells:
        frame = now.toPandas()
        known = [pd.factorize(frame[d]) for d in dims]
        wanted = [frame.groupby(c)[marks[d][0]].first().to_numpy() if len(frame) else np.zeros(0) for d, (c, _) in zip(dims, known)]
        w, residual = _fit(frame["tokens"].to_numpy(dtype=np.float64), [c for c, _ in known], wanted, tolerance, max_rounds)
        frame = frame.assign(weight=w, residual=residual).drop(columns=[marks[d][0] for d in dims])
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.schema)
        return spark.createDataFrame(list(frame[[*cells.columns, "weight", "residual"]].itertuples(index=False, name=None)), f"{fields}weight double, residual double")
    total = now.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    now, residual = now.withColumn("weight", F.col("tokens") / F.lit(total)), 1.0
    for _ in range(max_rounds):
        for d in dims:
            t, s = marks[d]
            sums = now.groupBy(d).agg(F.sum("weight").alias(s))
            now = now.join(sums, d).withColumn("weight", F.when(F.col(s) > 0, F.col("weight") * F.col(t) / F.col(s)).otherwise(0.0)).drop(s)
        now = cut(now)
        off = [now.groupBy(d).agg(F.abs(F.sum("weight") - F.first(marks[d][0])).alias("e")) for d in dims]
        residual = max((o.agg(F.max("e")).first()[0] or 0.0 for o in off), default=0.0)
        if residual <= tolerance:
            break
    return now.drop(*(marks[d][0] for d in dims)).withColumn("residual", F.lit(float(residual)))


def calibrated(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, **options) -> DataFrame:
    """``cells`` with ``weight``, ``residual``, ``probability`` and ``factor``.

    Probabilities are proportional to weight over tokens, at most 1, and such that the expected sample holds ``rate`` of
    all tokens. A cell whose share would be above 1 is taken whole, and ``factor`` (else 1) says how often its tokens
    would have to be repeated to meet the targets; so a tiny cell in demand never shrinks the rest.
    """
    fitted = rake(cells, targets or tempered_targets(cells), **options)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    fitted = fitted.withColumn("ratio", ratio)
    totals = fitted.agg(F.sum("tokens").cast("double"), F.sum("weight")).first()
    wanted, scale, clipped = rate * (totals[0] or 0.0), 0.0, -1
    while totals[1]:  # the scale only grows as cells are clipped, so this ends
        over = F.col("ratio") * F.lit(scale) >= 1
        whole, rest, n = fitted.agg(F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == clipped or rest <= 0:
            break
        scale, clipped = max(scale, (wanted - whole) / rest), n
    share = F.col("ratio") * F.lit(float(scale))
    return fitted.withColumns({"probability": F.least(share, F.lit(1.0)), "factor": F.greatest(share, F.lit(1.0))}).drop("ratio")


def uniform(seed: str, id_column: Column, text: Column) -> Column:
    """A number in [0, 1) from the id: the first 13 hexadecimal digits of md5(seed:id); without an id, from the text's md5."""
    named = F.coalesce(id_column.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), named)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, temperature: dict[str, float] = TEMPERATURE, topic: Column | None = None,
    tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, seed: str = SEED, small_cells: int = SMALL_CELLS,
) -> DataFrame:
    """The sampled rows of ``docs`` with ``topic``, ``tokens``, ``probability``, ``factor`` and ``residual``.

    ``residual`` is the same in every row: the largest difference of a marginal from its target. Over ``tolerance``, targets
    contradict each other or the table, or ``max_rounds`` were too few, and the sample meets them no nearer than that.

    ``targets`` gives shares by value for any of source, lang and topic, as ``{"lang": {"en": 0.5, "de": 0.5}}``; a value
    left out gets none. Dimensions without targets keep their tempered shares. ``topic`` is a column of the caller's; without one
    the look of the text serves. Poisson sampling: a document stays if its hash number is under its cell's probability,
    so equal ids stay or go together, whatever the partitioning; rows without an id go by their text. Null source or
    language is a value of its own (``''``). Documents without a word weigh nothing and go by their cell's probability; a
    cell without words has none and goes. Columns of ``docs`` with the added names are replaced; all others stay. An empty table gives no rows.
    """
    base = docs.drop("tokens", "probability", "factor", "residual") if topic is not None else docs.drop("topic", "tokens", "probability", "factor", "residual")
    keys = dict(zip(DIMENSIONS, free_names(base, "mx_source", "mx_lang", "mx_topic")))
    keyed = base.withColumns({keys["source"]: F.coalesce(F.col("source").cast("string"), F.lit("")), keys["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit("")), keys["topic"]: F.coalesce(topic.cast("string"), F.lit("")) if topic is not None else topic_of(F.col("text")), "tokens": tokens_of(F.col("text"))})
    cells = cut(keyed.groupBy(*(F.col(k).alias(d) for d, k in keys.items())).agg(F.sum("tokens").alias("tokens")))
    goals = tempered_targets(cells, temperature)
    for d, shares in (targets or {}).items():
        goals[d] = docs.sparkSession.createDataFrame([(v, float(t)) for v, t in shares.items()], f"{d} string, target double")
    side = cut(calibrated(cells, goals, rate, tolerance=tolerance, max_rounds=max_rounds, small_cells=small_cells))
    side = side.where("probability > 0").select(*(F.col(d).alias(k) for d, k in keys.items()), "probability", "factor", "residual")
    if side.count() <= small_cells:
        met = keyed.join(F.broadcast(side), list(keys.values()))
    else:  # a cell with a third of all documents is spread over as many parts as there are partitions
        (salt,) = free_names(keyed, "mx_salt")
        salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        side = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = keyed.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")).join(side, [*keys.values(), salt]).drop(salt)
    met = met.where(uniform(seed, F.col("doc_id"), F.col("text")) < F.col("probability"))
    return met.withColumn("topic", F.col(keys["topic"])).select(*(c for c in base.columns if c != "topic"), "topic", "tokens", "probability", "factor", "residual")


def op7_mixing(spark, sf_dir):
    """Sampled ``documents`` with their cell's probability."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"))


def _sql() -> str:
    share = " ".join(f"JOIN (SELECT {d}, p / sum(p) OVER () AS t_{d} FROM (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPERATURE[d]}) AS p FROM c GROUP BY {d} HAVING sum(tokens) > 0)) x_{d} USING ({d})" for d in DIMENSIONS)
    step = "r"
    for d in DIMENSIONS:
        step = f"(SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {step})"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
  CASE WHEN text IS NULL THEN 'none' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'licence' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^	-
 ]+')), 0) AS tokens FROM documents),
c AS MATERIALIZED (SELECT s AS source, l AS lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
r AS (SELECT 0 AS n, c.*, {', '.join(f't_{d}' for d in DIMENSIONS)}, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS w FROM c {share}
  UNION ALL SELECT n + 1, source, lang, topic, tokens, {', '.join(f't_{d}' for d in DIMENSIONS)}, w FROM {step} WHERE n < 200),
f AS (SELECT source, lang, topic, tokens, w, w / tokens AS ratio FROM r WHERE n = 200 AND tokens > 0 AND w > 0),
o AS (SELECT *, coalesce(sum(tokens) OVER b, 0) AS ct, coalesce(sum(w) OVER b, 0) AS cw, sum(w) OVER () AS aw FROM f WINDOW b AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT max(({RATE} * (SELECT sum(tokens) FROM c) - ct) / (aw - cw)) FILTER (WHERE aw - cw > 1e-12) AS scale FROM o),
p AS (SELECT source, lang, topic, least(ratio * scale, 1) AS probability FROM f, z)
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS BIGINT) AS tokens, round(p.probability, 6) AS probability
FROM d JOIN p ON d.s = p.source AND d.l = p.lang AND d.topic = p.topic
WHERE CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < p.probability
"""


SQL = _sql()
