"""Quotation linking: find what a message quotes, link it to the message that wrote it, order conversations by reply.

Built-in functions only. Lines, quote levels and passages are arrays inside a message's row; only hashes of passages
leave it. A conversation may hold a third of all rows: nothing is collected by conversation, and its running maxima and
positions are put together from ranges of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwave.operators.sizing import materialize

#: line before a quote that names who wrote it
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
QUOTE = r"^(?:[ \t]*>)+[ \t]?"
RANGE = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(text: Column) -> Column:
    """Struct of body (own lines; attribution lines before a quote left out) and passages.

    A passage is a run of lines of one quote level (number of leading ``>``); level 0 is the author's own.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: _let(
        F.regexp_extract(x, QUOTE, 0), lambda q: F.struct(
            F.char_length(F.regexp_replace(q, "[^>]", "")).alias("level"),
            F.substring(x, F.char_length(q) + 1, F.char_length(x)).alias("line"))))
    kept = lambda all_: F.filter(all_, lambda x, i: ~(
        (x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(all_, i + 1)["level"], F.lit(0)) > 0)))

    def passages(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | (x["level"] != F.get(all_, i - 1)["level"]), i)),
                          lambda i: i.isNotNull())
        run = lambda at, j, st: F.slice(all_, at + 1, F.coalesce(F.get(st, j + 1), F.size(all_)) - at)
        return _let(starts, lambda st: F.transform(st, lambda at, j: F.struct(
            F.get(all_, at)["level"].alias("level"), F.array_join(F.transform(run(at, j, st), lambda x: x["line"]), "\n").alias("text"))))

    own = lambda all_: F.array_join(F.transform(F.filter(all_, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return _let(lines, lambda every: _let(kept(every), lambda k: F.struct(
        F.regexp_replace(own(k), r"^\s+|\s+$", "").alias("body"), passages(k).alias("passages"))))


def _parts(text: Column) -> Column:
    """Whole passage, its paragraphs and its lines, normalised; empty ones left out."""
    every = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(every, normalised), lambda x: x != ""))


def _running_max(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Column before: largest value of rows of the same key with a smaller at; exact, in ranges of at."""
    rows = rows.withColumn("range", F.floor(F.col(at) / RANGE))
    inside = Window.partitionBy(*by, "range").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(value).over(inside))
    ends = rows.groupBy(*by, "range").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "range", F.max("top").over(earlier).alias("far"))
    return rows.join(ends, [*by, "range"]).withColumn("before", F.coalesce("near", "far")).drop("near", "far", "range")


def _positions(rows: DataFrame) -> DataFrame:
    """Column position (from 1): order of (root, turn, role, body) in each conversation, from counts of ranges."""
    rows = rows.withColumns({"rr": F.floor(F.col("root") / RANGE), "tr": F.floor(F.col("turn") / RANGE)})
    small = rows.groupBy("conv_id", "rr", "root", "tr").agg(F.count("*").alias("n"))
    large = small.groupBy("conv_id", "rr").agg(F.sum("n").alias("n"))
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    large = large.select("conv_id", "rr", ahead(["conv_id"], ["rr"]).alias("far"))
    small = small.select("conv_id", "rr", "root", "tr", ahead(["conv_id", "rr"], ["root", "tr"]).alias("near"))
    own = F.row_number().over(Window.partitionBy("conv_id", "root", "tr").orderBy("turn", "role", "body"))
    rows = rows.withColumn("own", own)
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    out = rows.join(small, same(rows, small, ("conv_id", "root", "tr"))).select(rows["*"], small["near"])
    out = out.join(large, same(out, large, ("conv_id", "rr"))).select(out["*"], large["far"])
    return out.withColumn("position", F.col("far") + F.col("near") + F.col("own")).drop("far", "near", "own", "rr", "tr")


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, n_quotes, quotes, reply_to, root, depth, position for every message.

    body is the text without quoted and attribution lines. A quoted passage (or a paragraph or line of it) is linked to
    the latest earlier turn of the conversation whose own words have the same hash; quotes lists (level, turn) of the
    linked ones. reply_to is the turn that the level-1 quotes match most characters of (the later one of equals). root is
    the first turn of the reply chain, depth the number of replies up to it; position orders a conversation by root, then
    by turn, so that every message stands after the one it answers.

    Null or empty text: empty body, no quotes. Rows that share conversation and turn are one message for linking, all
    are returned. A null conv_id or turn is never linked; null turns come first. Empty table: no rows.
    """
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        parse(F.col(text)).alias("p"))
    rows = materialize(rows.select("conv_id", "turn", "role", "p.body", "p.passages"))
    quoted = F.filter("passages", lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))
    rows_q = rows.withColumn("n_quotes", F.size(quoted))
    known = rows.filter("conv_id is not null and turn is not null")
    asked = known.select("conv_id", "turn", F.explode(quoted).alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), F.explode(_parts(F.col("q.text"))).alias("part"))
    asked = materialize(asked.select("conv_id", "turn", "level", F.xxhash64("part").alias("hash"),
                                     F.char_length("part").alias("size")).distinct())
    base = rows_q.select("conv_id", "turn", "role", "body", "n_quotes")
    none = F.array().cast("array<struct<level:int,turn:bigint>>")
    if asked.isEmpty():
        plain = base.withColumns({
            "quotes": none, "reply_to": F.lit(None).cast("long"), "root": F.col("turn"), "depth": F.lit(0)})
        return _positions(plain)
    said = known.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.explode(F.concat(_parts(F.col("body")), F.flatten(F.transform(
            F.filter("passages", lambda p: p["level"] == 0), lambda p: _parts(p["text"]))))).alias("part"))
    said = said.select("conv_id", "turn", F.xxhash64("part").alias("hash")).distinct()
    said = said.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    both = said.select("conv_id", "hash", "turn", F.col("turn").alias("wrote"), F.lit(None).cast("int").alias("level"),
                       F.lit(None).cast("int").alias("size")).unionByName(
        asked.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("wrote"), "level", "size"))
    found = _running_max(both, ["conv_id", "hash"], "turn", "wrote").filter("level is not null and before is not null")
    found = materialize(found.select("conv_id", "turn", "level", "size", F.col("before").alias("to")))
    score = found.filter("level = 1").groupBy("conv_id", "turn", "to").agg(F.sum("size").alias("size"))
    parents = score.groupBy("conv_id", "turn").agg(F.max_by("to", F.struct("size", "to")).alias("reply_to"))
    links = found.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set(F.struct("level", F.col("to").alias("turn")))).alias("quotes"))
    parents = materialize(parents)
    chain = materialize(parents.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:  # each round doubles how far a message sees up its chain
        up = chain.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = materialize(chain.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        chain = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    out = base.join(links, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").join(
        chain, ["conv_id", "turn"], "left")
    out = out.withColumns({
        "quotes": F.coalesce("quotes", none), "root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    return _positions(out)


def op8_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
