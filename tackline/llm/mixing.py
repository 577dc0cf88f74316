"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted by cell (source, language, topic), their tokens summed
before any shuffle. Cell weights start at the tokens and are raked: scaled to
each margin's targets in turn, and never above the tokens that the cell has, until
all margins hold. The total is as large as the margins allow, less a little
slack. The rarest values of a tempered margin, which together hold at most
``RARE`` of its tokens, do not bound it: where they are short, their target is
what they hold, less the slack, and the others of the margin share out the
rest. Stated targets are never lowered. A cell's weight over its tokens is the probability at which each of its
documents is kept; expected token shares of what is kept are then the targets. Which documents those are follows from a hash of the id, so the same
table gives the same sample.

Defined cases: a null or empty text counts one token, for the document's end;
a null source, language or topic is a value of its own; repeated rows with one
id are kept or dropped together, rows with null ids by their text; columns
whose names are used here for results are replaced by them in :func:`probabilities` and
kept as they are in :func:`sample`; an empty table gives an empty result.
Targets without any cell are left out and the others scaled up. Where margins
contradict each other, raking stops when it comes no nearer, with the last margin
holding, and the column ``off`` of the cells, and ``margins_off`` of the documents,
tell by how much the worst margin is off. A text of any length counts whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tackline.llm.durable import checkpointed, written

#: Cells up to this many are raked in one task and broadcast; more are raked by joins and joined by shuffle.
FEW_CELLS = 100_000
#: Raking ends when no margin is off by more than this share, when a round brings the worst margin hardly nearer, or after so many rounds.
TOLERANCE, STALLED, MOST_ROUNDS = 1e-6, 0.999, 50
#: Share of the largest total that no margin's value is too small for.
SLACK = 0.9
#: Share of a tempered margin's tokens that its rarest values, by doublings of their tokens, may hold together without bounding the total.
RARE = 0.01
DIMENSIONS = ("source", "lang", "topic")


def layout_topic(text: Column) -> Column:
    """A coarse topic by layout, for tables without one: table, markup, notice, code, note or prose."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.contains(" | "), "table")
        .when(text.rlike(r"[#*$%&]{3}"), "markup")
        .when(text.contains("!! "), "notice")
        .when(text.contains(' = "'), "code")
        .when(F.length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words, and one for the document's end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a margin: the natural shares to a power, scaled to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).withColumn("t", F.pow("t", F.lit(power)))
    total = sums.agg(F.sum("t")).first()[0] or 1.0
    return sums.select(F.col(dim).alias("value"), (F.col("t") / total).alias("target"))


def _rare_below(classes: dict[int, float]) -> int:
    """From tokens by class of values (binary digits of a value's tokens), the first class that is not rare."""
    left = RARE * sum(classes.values())
    for digits in sorted(classes):
        left -= classes[digits]
        if left < 0:
            return digits
    return 0


def _largest_total(has: np.ndarray, share: np.ndarray, stated: bool) -> float:
    """The largest total at which all but rare values reach their shares."""
    digits = np.frexp(has)[1]
    low = 0 if stated else _rare_below({int(d): has[digits == d].sum() for d in np.unique(digits)})
    some = share > 0
    bound = some & (digits >= low)
    level = SLACK * (has[bound] / share[bound]).min(initial=np.inf)
    return np.minimum(SLACK * has[some], level * share[some]).sum()


def _filled(has: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """Targets in tokens that come to the total: in proportion to the shares, but for values that are short."""
    level, short = total, np.zeros(len(has), bool)
    while True:
        more = short | (level * share > SLACK * has * (1 + 1e-9))
        rest = share[~more].sum()
        if (more == short).all() or rest <= 0:
            return np.where(more, SLACK * has, level * share)
        short, level = more, (total - SLACK * has[more].sum()) / rest


def _present_targets(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict]) -> dict[str, DataFrame]:
    """Each margin's targets (value, target) in tokens, of values that have cells: as :func:`_largest_total` and :func:`_filled` say."""
    spark, shares, most = cells.sparkSession, {}, np.inf
    for dim in DIMENSIONS:
        here = tempered(cells, dim, powers[dim])
        if dim in targets:
            stated = spark.createDataFrame([(v, float(t)) for v, t in targets[dim].items()], "value string, target double").where("target > 0")
            here = here.drop("target").join(stated.withColumnRenamed("value", "_v"), F.col("value").eqNullSafe(F.col("_v"))).drop("_v")
        whole = here.agg(F.sum("target")).first()[0] or 1.0
        has = cells.groupBy(F.col(dim).alias("_v")).agg(F.sum("tokens").alias("has"))
        here = here.join(has, F.col("value").eqNullSafe(F.col("_v"))).select("value", (F.col("target") / whole).alias("share"), (SLACK * F.col("has")).alias("room"), F.length(F.bin("has")).alias("digits"), "has")
        shares[dim] = here = checkpointed(here)
        low = 0 if dim in targets else _rare_below({r["digits"]: float(r["t"]) for r in here.groupBy("digits").agg(F.sum("has").alias("t")).collect()})
        level = here.where(F.col("digits") >= low).agg(F.min(F.col("room") / F.col("share"))).first()[0] or 0.0
        most = min(most, here.agg(F.sum(F.least("room", F.lit(level) * F.col("share")))).first()[0] or 0.0)
    out = {}
    for dim, here in shares.items():
        level, n_short = most, 0
        while True:
            short = F.lit(level) * F.col("share") > F.col("room") * (1 + 1e-9)
            n, held, rest = here.agg(F.count_if(short), F.sum(F.when(short, F.col("room")).otherwise(0.0)), F.sum(F.when(short, 0.0).otherwise(F.col("share")))).first()
            if n == n_short or not rest:
                break
            n_short, level = n, (most - held) / rest
        out[dim] = here.select("value", F.when(short, F.col("room")).otherwise(F.lit(level) * F.col("share")).alias("target"))
    return out


def rake_many(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict]) -> DataFrame:
    """The cells with ``weight``, raked by joins: for more cells than one task should hold; ``off`` is what the last round still found amiss.

    Sums are taken by margin with partial aggregation, never by bringing a margin's cells together.
    """
    fixed = _present_targets(cells, powers, targets)
    now = written(cells.select(*DIMENSIONS, "tokens", F.col("tokens").cast("double").alias("weight")))
    worst = np.inf
    for _ in range(MOST_ROUNDS):
        before, worst = worst, 0.0
        for dim in DIMENSIONS:
            # each step is written and read back: a plan that went on through the rounds would grow with them
            sums = now.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("has"))
            want = fixed[dim].select(F.col("value").alias("_v"), "target")
            ratio = sums.join(want, sums["value"].eqNullSafe(want["_v"]), "left").select(F.col("value").alias("_value"), F.coalesce(F.col("target"), F.lit(0.0)).alias("want"), "has")
            ratio = written(ratio)
            gap = F.when(F.col("want") > 0, F.abs(F.col("has") / F.col("want") - 1)).otherwise(F.when(F.col("has") > 0, 1.0).otherwise(0.0))
            off, n = ratio.agg(F.max(gap), F.count("*")).first()
            worst = max(worst, off or 0.0)
            if not off or off < TOLERANCE / 10:
                continue
            factor = F.when(F.col("has") > 0, F.col("want") / F.col("has")).otherwise(0.0)
            ratio = ratio.select("_value", factor.alias("factor"))
            ratio = F.broadcast(ratio) if n <= FEW_CELLS else ratio
            now = written(now.join(ratio, now[dim].eqNullSafe(ratio["_value"])).select(*DIMENSIONS, "tokens", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("factor")).alias("weight")))
        if worst < TOLERANCE or worst > STALLED * before:
            break
    return now.withColumn("off", F.lit(worst))


def rake_few(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict]) -> DataFrame:
    """The same by arrays in one task, for at most ``FEW_CELLS`` cells."""
    schema = T.StructType([*cells.select(*DIMENSIONS, "tokens").schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("off", T.DoubleType())])

    def run(batches):
        table = pd.concat(list(batches) or [pd.DataFrame(columns=[*DIMENSIONS, "tokens"])], ignore_index=True)
        # rows come in any order; sums are taken in one
        table = table.sort_values(list(DIMENSIONS), na_position="first", ignore_index=True)
        tokens, margins, most = table.tokens.to_numpy(float), [], np.inf
        for dim in DIMENSIONS:
            code, values = pd.factorize(table[dim], use_na_sentinel=False)
            has, stated = np.bincount(code, tokens, len(values)), targets.get(dim)
            want = np.array([stated.get(None if pd.isna(v) else v, 0.0) for v in values]) if stated is not None else has ** powers[dim]
            want = want / max(want.sum(), 1e-300)
            most = min(most, _largest_total(has, want, stated is not None))
            margins.append((code, has, want))
        weight, margins = tokens, [(code, _filled(has, want, most)) for code, has, want in margins]
        worst = np.inf
        for _ in range(MOST_ROUNDS):
            before, worst = worst, 0.0
            for code, want in margins:
                has = np.bincount(code, weight, len(want))
                ratio = np.divide(want, has, out=np.zeros_like(want), where=has > 0)
                worst = max(worst, np.abs(np.where(want > 0, np.divide(has, want, out=np.zeros_like(want), where=want > 0) - 1, (has > 0).astype(float))).max(initial=0))
                weight = np.minimum(tokens, weight * ratio[code])
            if worst < TOLERANCE or worst > STALLED * before:
                break
        yield table.assign(weight=weight, off=worst)[[*DIMENSIONS, "tokens", "weight", "off"]]

    return cells.select(*DIMENSIONS, "tokens").repartition(1).mapInPandas(run, schema)


def cell_probabilities(docs: DataFrame, topic: Column, powers: dict[str, float], targets: dict[str, dict] | None = None, text_col: str = "text", few: int | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight, off, probability) of every cell; ``off`` is the largest share that a margin is off by in the end. ``targets`` states shares by dimension and value; other margins are tempered."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.alias("topic"), tokens_of(F.col(text_col)).alias("tokens"))
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    few = FEW_CELLS if few is None else few
    weighted = (rake_few if cells.limit(few + 1).count() <= few else rake_many)(cells, powers, targets or {})
    return checkpointed(weighted).select(*DIMENSIONS, "tokens", "weight", "off", (F.col("weight") / F.col("tokens")).alias("probability"))


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text where there is no id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, F.when(doc_id.isNull(), text)), 11) / F.lit(float(1 << 53))


def _with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows has __mix_source, __mix_lang and __mix_topic; adds __mix_probability."""
    cells = cells.select(*[F.col(d).alias(f"__cell_{d}") for d in DIMENSIONS], F.col("probability").alias("__mix_probability"), F.col("off").alias("__mix_off"))
    if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        cells = F.broadcast(cells)
    on = [F.col(f"__mix_{d}").eqNullSafe(F.col(f"__cell_{d}")) for d in DIMENSIONS]
    return rows.join(cells, on[0] & on[1] & on[2]).drop(*[f"__cell_{d}" for d in DIMENSIONS])


def probabilities(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None, seed: int = 17, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, source, lang, topic, tokens, probability, kept, margins_off."""
    topic = layout_topic(F.col(text_col)) if topic is None else topic
    cells = cell_probabilities(docs, topic, powers or POWERS, targets, text_col)
    u = _uniform(F.col(id_col), F.col(text_col), seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("__mix_source"), F.col("lang").cast("string").alias("__mix_lang"), topic.alias("__mix_topic"), tokens_of(F.col(text_col)).alias("tokens"), u.alias("__mix_u"))
    return _with_probability(rows, cells).select("doc_id", *[F.col(f"__mix_{d}").alias(d) for d in DIMENSIONS], "tokens", F.col("__mix_probability").alias("probability"), (F.col("__mix_u") < F.col("__mix_probability")).alias("kept"), F.col("__mix_off").alias("margins_off"))


def sample(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None, seed: int = 17, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns that they had."""
    topic = layout_topic(F.col(text_col)) if topic is None else topic
    cells = cell_probabilities(docs, topic, powers or POWERS, targets, text_col)
    rows = docs.withColumns({"__mix_source": F.col("source").cast("string"), "__mix_lang": F.col("lang").cast("string"), "__mix_topic": topic, "__mix_u": _uniform(F.col(id_col), F.col(text_col), seed)})
    return _with_probability(rows, cells).where("__mix_u < __mix_probability").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Powers of natural shares that the targets are, by dimension.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
