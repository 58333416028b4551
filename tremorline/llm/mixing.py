"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities.

Iterative proportional fitting on the table of token counts by (source, language, topic): each pass multiplies the
cells' probabilities so that the expected sampled tokens of every source, then language, then topic equal their target, and cuts them
at 1, for a document can be taken only once; later passes then raise other cells instead. Targets share out `share` of all tokens, by
default in proportion to the actual tokens raised to a power below one, so large sources shrink and small ones
grow; or as `targets` gives them, a margin's categories with their weights (those it does not name get none). The size of the sample is thus
fixed beforehand: a rare cell that cannot reach its target is taken whole and shrinks nothing else. `marginals` reports what was
reached. The draw is a hash of doc_id, the same in every run.

Only DataFrame functions are used. Text is never shuffled where the cell table is small (its rows are
counted first); the marginals are partial aggregates, so a hot source costs no more than any other.

Defined results: null source or language is the category `(none)`; null or empty text has 0 tokens and topic `(none)`;
cells without tokens keep the probability of their other marginals; a null doc_id draws as the empty string; equal ids draw alike, so repeated
rows come or go together; very long texts are counted whole; an empty table gives no rows; extra columns are ignored, but for `topic` where it is
named.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import textkit as K

NONE = "(none)"
#: Topics in order of precedence, each with the strings any of which a text of it holds; other texts are prose.
TOPICS = [
    ("legal", ["licensed under", "Licensed under", "Copyright", "All rights reserved"]),
    ("contact", ["@"]),
    ("table", [" | "]),
    ("code", [";\n", "{\n", ' = "', "function ", "def "]),
    ("noise", ["***", "$$$", "%%%", "###", "&&&"]),
]
#: Power of the actual share that makes the target share.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.8}
ROUNDS = 12
#: Share of all tokens that the sample is to hold.
SHARE = 0.5
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
#: Cell tables of at most so many rows are broadcast to the documents.
SMALL = 50_000


def topic(text: Column) -> Column:
    found = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(NONE))
    for name, marks in TOPICS:
        found = found.when(reduce(or_, [text.contains(m) for m in marks]), F.lit(name))
    return found.otherwise(F.lit("prose"))


def describe(docs: DataFrame, topic_column: str | None = None) -> DataFrame:
    """docs with the columns _source, _lang, _topic and _tokens; the topic is that column's, or found by `TOPICS`."""
    text = F.col("text")
    return docs.withColumns({
        "_source": F.coalesce(F.col("source"), F.lit(NONE)), "_lang": F.coalesce(F.col("lang"), F.lit(NONE)),
        "_topic": F.coalesce(F.col(topic_column).cast("string"), F.lit(NONE)) if topic_column else topic(text),
        "_tokens": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
    })


def _target(cells: DataFrame, name: str, power: float, weights: dict[str, float] | None) -> DataFrame:
    """(_name, p): the weight of each category of a margin."""
    own = cells.groupBy(f"_{name}").agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("p"))
    if weights is None:
        return own
    given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in sorted(weights.items())], f"_{name} string, p double")
    return own.select(f"_{name}").join(F.broadcast(given), f"_{name}", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, small: int = SMALL, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells (_source, _lang, _topic, n) with the column m, the probability of their documents after the last round.

    A table of at most `small` cells is raked in one partition by windows, a larger one by partial aggregates and joins.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    margins = {}
    for name, power in powers.items():
        marginal = K.saved(_target(cells, name, power, (targets or {}).get(name)), f"target-{name}")
        whole = float(marginal.agg(F.sum("p")).first()[0] or 1)
        margins[name] = marginal.select(f"_{name}", (F.lit(share) * F.lit(total) * F.col("p") / F.lit(whole)).alias("target"))
    cells = K.saved(cells.withColumn("m", F.lit(float(share))), "cells")

    def fitted(now: str, target: str):
        return F.least(F.lit(1.0), F.col("m") * F.when(F.col(now) > 0, F.col(target) / F.col(now)).otherwise(F.lit(1.0)))

    if cells.count() <= small:  # one partition meets every window's distribution: no shuffle at all
        for name in powers:
            cells = cells.join(F.broadcast(margins[name].withColumnRenamed("target", f"_target_{name}")), f"_{name}")
        cells = cells.coalesce(1)
        for k in range(rounds):
            for name in powers:
                now = F.sum(F.col("n") * F.col("m")).over(W.partitionBy(f"_{name}"))
                cells = cells.withColumn("_now", now).withColumn("m", fitted("_now", f"_target_{name}"))
            if k % 4 == 3 or k == rounds - 1:
                cells = K.saved(cells, "cells").coalesce(1)
        return cells.select("_source", "_lang", "_topic", "n", "m")
    for _ in range(rounds):
        for name in powers:
            now = cells.groupBy(f"_{name}").agg(F.sum(F.col("n") * F.col("m")).alias("now")).join(margins[name], f"_{name}")
            cells = cells.join(now, f"_{name}").withColumn("m", fitted("now", "target")).drop("now", "target")
        cells = K.saved(cells, "cells")
    return cells.select("_source", "_lang", "_topic", "n", "m")


def _counted(rows: DataFrame) -> DataFrame:
    return K.saved(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")), "counts")


def calibrated(rows: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with _probability, broadcast where their counted number allows; rows has describe()'s columns."""
    cells = rake(_counted(rows), powers, rounds, share=share, targets=targets).select("_source", "_lang", "_topic", F.col("m").alias("_probability"))
    return F.broadcast(cells) if cells.count() <= SMALL else cells


def marginals(docs: DataFrame, topic_column: str | None = None, **how) -> DataFrame:
    """margin, category, its tokens, and the tokens expected in the sample; `how` as in `rake`."""
    cells = K.saved(rake(_counted(describe(docs, topic_column)), **how), "raked")
    each = [cells.groupBy(F.col(f"_{name}").alias("category")).agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("m")).alias("expected")).withColumn("margin", F.lit(name)) for name in how.get("powers", POWERS)]
    return reduce(DataFrame.unionByName, each).select("margin", "category", "tokens", "expected")


def _drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    unit = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.join(cells, ["_source", "_lang", "_topic"]).withColumn("_sampled", unit < F.col("_probability"))


def probabilities(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, share: float = SHARE, targets: dict[str, dict[str, float]] | None = None, topic_column: str | None = None) -> DataFrame:
    """doc_id, _source, _lang, _topic, _tokens, _probability and _sampled; whole texts are scanned once."""
    extra = [topic_column] if topic_column else []
    rows = K.saved(describe(docs.select("doc_id", "text", "lang", "source", *extra), topic_column).select("doc_id", "_source", "_lang", "_topic", "_tokens"), "described")
    return _drawn(rows, calibrated(rows, powers, rounds, share, targets))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, topic, probability, weight (what a sampled document stands for: 1 / probability) and whether it is sampled."""
    out = probabilities(docs)
    weight = F.when(F.col("_probability") > 0, F.round(F.lit(1.0) / F.col("_probability"), 6))
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), weight.alias("weight"), F.round("_probability", 9).alias("probability"), F.col("_sampled").alias("sampled"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, some `SHARE` of all tokens; the second scan only finds each text's topic again.

    Null and odd rows as in `probabilities`; an empty table stays empty; extra columns go.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = describe(docs.select(*columns))
    return _drawn(rows, calibrated(rows)).where("_sampled").select(*columns)


def sql(table: str = "documents", powers: dict[str, float] = POWERS, rounds: int = ROUNDS, share: float = SHARE) -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    cases = " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{n}'" for n, marks in TOPICS)
    parts = [
        f"""rows0 AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS _source, coalesce(lang, '{NONE}') AS _lang,
        CASE WHEN coalesce(length(text), 0) = 0 THEN '{NONE}' {cases} ELSE 'prose' END AS _topic,
        coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS _tokens FROM {table})""",
        f"c0 AS MATERIALIZED (SELECT _source, _lang, _topic, sum(_tokens)::DOUBLE AS n, {share}::DOUBLE AS m FROM rows0 GROUP BY ALL)",
    ]
    for name, power in powers.items():
        parts.append(
            f"t_{name} AS MATERIALIZED (SELECT _{name}, {share}::DOUBLE * (SELECT sum(n) FROM c0) * p / sum(p) OVER () AS target FROM (SELECT _{name}, pow(sum(n), {power}::DOUBLE) AS p FROM c0 GROUP BY 1))"
        )
    last, k = "c0", 0
    for _ in range(rounds):
        for name in powers:
            k += 1
            parts.append(
                f"c{k} AS MATERIALIZED (SELECT c.* EXCLUDE (m), least(1.0::DOUBLE, c.m * CASE WHEN s.cur > 0 THEN t.target / s.cur ELSE 1.0::DOUBLE END) AS m FROM {last} c JOIN t_{name} t USING (_{name}) JOIN (SELECT _{name}, sum(n * m) AS cur FROM {last} GROUP BY 1) s USING (_{name}))"
            )
            last = f"c{k}"
    parts.append(f"p AS (SELECT *, m AS prob FROM {last})")
    return (
        "WITH " + ", ".join(parts) + """ SELECT doc_id, _tokens AS n_tokens, _topic AS topic, CASE WHEN prob > 0 THEN round(1.0::DOUBLE / prob, 6) END AS weight, round(prob, 9) AS probability,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE < prob AS sampled
        FROM rows0 JOIN p USING (_source, _lang, _topic)"""
    )
