"""Order MinHash fingerprints with built-in functions only.

A text is its sequence of pieces (what stands between white space, cut after PIECE characters), a k-mer is GRAM pieces
in a row. Each k-mer is numbered by its occurrence in the text and hashed together with that number. Each of SLOTS slots
has an order of its own of all k-mers: first those whose hash deals them to the slot, by that hash, then all others by a
hash seeded with the slot. The two smallest k-mers of the whole text are drawn, put in the order in which they stand in
the text and hashed as a pair. So a slot agrees between two texts only where the same k-mers are drawn and stand in the
same order, as edits of a text leave most of them and moves do not. Seeded hashes are made only for slots that fewer than
two k-mers are dealt to, as in texts of a few hundred pieces; a single k-mer fills a slot only in texts that have no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
SLOTS = 64
SLOT_BITS = 6
PIECE = 16
#: bits of a sorted key that hold a k-mer's place in the text; beyond 16.7 million pieces places count as equal
PLACE_BITS = 24
_PLACES = 1 << PLACE_BITS
#: documents in a chunk of neighbouring ids
CHUNK = 1000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column) -> Column:
    """Array of SLOTS ints; 0 marks a slot without k-mers. Null and empty text have no k-mers."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{PIECE}}}"), 0)

    def numbered(w: Column) -> Column:
        """Sorted array of (hash of k-mer, place) in one long."""
        last = F.greatest(F.size(w) - GRAM + 1, F.least(F.size(w), F.lit(1)))
        grams = F.transform(F.slice(w, 1, last), lambda x, i: F.shiftleft(
            F.shiftrightunsigned(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)]), PLACE_BITS + 1), PLACE_BITS
        ).bitwiseOR(F.least(i, F.lit(_PLACES - 1)).cast("long")))
        return F.sort_array(grams)

    assert SLOTS == 1 << SLOT_BITS
    hash_bits = 63 - PLACE_BITS
    place = lambda x: x.bitwiseAND(F.lit(_PLACES - 1).cast("long"))
    own = lambda x: F.shiftright(x, PLACE_BITS)
    slot = lambda x: F.shiftright(x, PLACE_BITS + hash_bits - SLOT_BITS).cast("int")

    def packed(h: Column, at: Column) -> Column:
        """Upper bits of the hash and the place, in one long that is not negative."""
        return F.shiftleft(F.shiftrightunsigned(h, 1 + PLACE_BITS), PLACE_BITS).bitwiseOR(at)

    def keys(s: Column) -> Column:
        """Sorted array of (hash with occurrence number, place) in one long; the slot is in the upper bits."""
        starts = F.filter(F.transform(s, lambda x, i: F.when(
            (i == 0) | (own(x) != own(F.get(s, i - 1))), i)), lambda i: i.isNotNull())

        def run(at: Column, j: Column, all_starts: Column) -> Column:
            stop = F.coalesce(F.get(all_starts, j + 1), F.size(s))
            return F.transform(F.slice(s, at + 1, stop - at), lambda x, n: packed(F.xxhash64(own(x), n), place(x)))

        return _let(starts, lambda st: F.sort_array(F.flatten(F.transform(st, lambda at, j: run(at, j, st)))))

    def pair(x: Column, y: Column) -> Column:
        """Hash of two k-mers in text order, or of the only one."""
        h = F.when(y.isNull(), F.hash(own(x), F.lit(-1).cast("long"))).when(
            place(x) <= place(y), F.hash(own(x), own(y))).otherwise(F.hash(own(y), own(x)))
        return F.when(h == 0, 1).otherwise(h)

    def slots(k: Column) -> Column:
        """One int for each slot."""
        firsts = F.filter(F.transform(k, lambda x, i: F.when((i == 0) | (slot(x) != slot(F.get(k, i - 1))), F.struct(
            slot(x).alias("s"), F.struct(x.alias("x"), F.when(slot(F.get(k, i + 1)) == slot(x), F.get(k, i + 1)).alias("y")).alias("d")))),
            lambda e: e.isNotNull())

        def seeded(i: Column) -> Column:
            """All k-mers that are not dealt to slot i, in the slot's own order."""
            return F.transform(k, lambda x: F.when(slot(x) != i, packed(F.xxhash64(own(x), i), place(x))))

        def one(i: Column, d: Column) -> Column:
            def fill(c: Column) -> Column:
                least = F.array_min(c)
                return F.when(d.isNotNull(), pair(d["x"], least)).otherwise(
                    _let(least, lambda m: pair(m, F.array_min(F.filter(c, lambda v: v > m)))))

            return F.when(d["y"].isNotNull(), pair(d["x"], d["y"])).otherwise(_let(seeded(i), fill))

        made = _let(F.map_from_entries(firsts), lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: _let(m[i], lambda d: one(i, d))))
        return F.when(F.size(k) == 0, F.array_repeat(F.lit(0), SLOTS)).otherwise(made)

    return _let(_let(_let(pieces, numbered), keys), slots)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either fingerprint has; 1 for two texts without any."""
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: ((x == y) & (x != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, 1.0).otherwise(equal / either)


def as_text(a: Column) -> Column:
    """Eight hex digits a slot."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")), 8, "0")), "")


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Each row with column next_row: a struct of the given columns of the row that follows in descending doc_id.

    The rows are cut into chunks of neighbouring ids at ids that occur; a chunk's highest row is also sent to the chunk
    above, where it follows the lowest one, and the highest of all to the lowest chunk. So rows move once, no task holds
    more than a chunk, and no window runs over the whole table. Rows that share an id stand in the order of their text
    hashes; a null id stands behind all others.
    """
    from pyspark.sql import Window

    ids = docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("i"))
    n = ids.count()
    if not n:
        return docs.withColumn("next_row", F.lit(None).cast(docs.select(F.struct(*columns)).schema[0].dataType))
    cuts = min(10_000, -(-n // chunk))
    accuracy = max(10_000, 20 * cuts)
    edges = sorted(set(ids.agg(F.percentile_approx("i", [(k + 1) / cuts for k in range(cuts)], accuracy)).head()[0]))
    edges[-1] = ids.agg(F.max("i")).head()[0]
    key = F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))
    limits = F.array(*[F.lit(e) for e in edges])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*columns).alias("own"), key.alias("key"),
                       F.xxhash64(*columns).alias("tie"))
    # edges[k] is the highest id of chunk k
    rows = rows.withColumn("k", F.size(F.filter(limits, lambda e: e < F.col("key"))))
    top = F.array_contains(limits, F.col("key"))
    above = F.when(top, F.struct(F.when(F.col("k") == len(edges) - 1, -1).otherwise(F.col("k") + 1).alias("k"),
                                 F.lit(True).alias("guest")))
    copies = F.filter(F.array(F.struct(F.col("k").alias("k"), F.lit(False).alias("guest")), above), lambda x: x.isNotNull())
    dealt = rows.withColumn("to", F.explode(copies)).withColumns({
        "chunk": F.when(F.col("to.k") == -1, 0).otherwise(F.col("to.k")), "guest": F.col("to.guest"),
        # guests come last in their chunk: they follow its lowest row
        "late": F.col("to.guest"),
    })
    dealt = dealt.select("chunk", "guest", "key", "tie", "own", F.when(~F.col("guest"), F.col("row")).alias("row"))
    order = Window.partitionBy("chunk").orderBy("guest", F.desc("key"), "tie")
    found = dealt.withColumn("next_row", F.lead("own").over(order)).filter("not guest")
    return found.select("row.*", "next_row")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of the text and its edited text, and two likenesses.

    The edited text keeps all but the last floor(n_chars / 2) code points and goes on with as many first code points of
    the next document (descending doc_id, after the last the first). Null text is empty; a single document is its own
    next one. Rows that share an id follow one another in the order of their hashes. Empty table: no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("fp", fingerprint(F.col("text")))
    pairs = with_next(base, ["text", "fp"], "doc_id")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_row.text"), F.lit(1), half))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next_row.fp").alias("next_fp"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp",
                       fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
