"""Removal of repeated passages by content-defined chunks of lines. DataFrame and SQL functions only.

A line's number is the first 32 bits of its MD5. The rolling number of a line joins those of the lines in a window that
ends there; where it is 0 modulo a divisor, a chunk ends. Chunks so depend on nearby lines only and line up again
after an insertion. A chunk of two lines or more, or of a line of 50 words or more, that occurs again anywhere is removed but for its first occurrence
(smallest doc_id, then place), after its bytes were compared with that one's.

Boundaries fall by luck, so that chunks alone miss most short passages. dedup_passages() also removes every run of lines
of 50 words or more that occurs again, wherever the boundaries are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import save

# Joins of texts with what grows with the corpus are merge joins by hint: one plan at every size, and no broadcast without a bound.

WINDOW = 2
DIVISOR = 3
BASE = 1_000_003
#: A chunk counts from so many lines, or from so many words on one: a long passage may stand on a single line.
LEAST_LINES, LEAST_WORDS = 2, 50
#: Occurrences of a repeated chunk that are compared in one task; a chunk with more is dealt to as many as it needs.
SALT_ROWS = 5_000
#: Bits of the map that spares texts a shuffle: 16 for each repeated chunk, and at most so many.
MOST_MARKS = 1 << 24


def line_chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<first, n, text>>: the chunks of a text in order; joined by line feeds they give it back.

    Null gives null; an empty text is one empty line.
    """
    lines = F.split(text, "\n", -1)

    def ends(h: Column) -> Column:
        def is_end(_: Column, i: Column) -> Column:
            roll = sum((F.when(i >= k, F.get(h, (i - k).cast("int"))).otherwise(F.lit(0)) * F.lit(BASE**k) for k in range(window)), F.lit(0).cast("long"))
            return (F.pmod(roll, F.lit(divisor)) == 0) | (i == F.size(h) - 1)

        return F.filter(F.transform(h, lambda x, i: F.when(is_end(x, i), i + 1)), lambda x: x.isNotNull())

    def begin(s: Column, j: Column) -> Column:
        return F.when(j == 0, F.lit(0)).otherwise(F.get(s["e"], j - 1))

    # struct of one so that each step's array is made once
    hashed = F.transform(F.array(lines), lambda ls: F.named_struct(F.lit("ls"), ls, F.lit("h"), F.transform(ls, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long"))))
    ended = F.transform(hashed, lambda s: F.named_struct(F.lit("ls"), s["ls"], F.lit("e"), ends(s["h"])))
    made = F.transform(
        ended,
        lambda s: F.transform(
            s["e"],
            lambda e, j: F.named_struct(
                *(F.lit("first"), begin(s, j).cast("int")),
                *(F.lit("n"), (e - begin(s, j)).cast("int")),
                *(F.lit("text"), F.array_join(F.slice(s["ls"], begin(s, j) + 1, e - begin(s, j)), "\n")),
            ),
        ),
    )
    return F.when(text.isNotNull(), F.get(made, F.lit(0)))


def _may_have(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose _key may be among those of `keys` (count rows): all that are, and few others while the map has bits to spare.

    The map is a table of 64-bit words, at most MOST_MARKS / 64 rows, which bounds its broadcast. The join that follows
    drops what it lets through by chance.
    """
    bits = min(MOST_MARKS, 1 << max(16, (16 * count).bit_length()))
    word = F.shiftright(F.col("_key").bitwiseAND(F.lit(bits - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(_key & 63 as int))")
    words = keys.select(word.alias("_w"), bit.alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m"))
    return rows.withColumn("_v", word).join(F.broadcast(words), F.col("_v") == F.col("_w")).where(F.col("_m").bitwiseAND(bit) != 0).select(*rows.columns)


def repeated_chunks(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_id, _key, gone: array<int>): the first lines of chunks to remove, for rows that have any.

    _key is a hash of the text beside the id, so that rows which share an id are told apart; rows that repeat both id
    and text are one document and get one answer. A null id sorts last.
    """
    keyed = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    every = keyed.select("_id", "_key", F.explode(F.filter(line_chunks(F.col("text")), lambda c: (c["n"] >= least_lines) | (F.regexp_count(c["text"], F.lit("[^ \\t\\n\\r]+")) >= least_words))).alias("c"))
    places = save(every.select("_id", "_key", F.col("c.first").alias("first"), F.xxhash64("c.text", F.lit(1)).alias("_h"), F.xxhash64(F.lit(2), "c.text").alias("_g")))
    order = F.struct(F.col("_id").isNull().alias("a"), F.coalesce("_id", F.lit(0)).alias("b"), F.col("_key").alias("k"), F.col("first").alias("f"))
    twice = places.groupBy("_h", "_g").agg(F.min(order).alias("lead"), F.count("*").alias("m")).where("m > 1")
    twice = save(twice.withColumn("salts", (F.col("m") / SALT_ROWS).cast("int") + 1))
    copies = places.join(twice, ["_h", "_g"]).withColumn("leads", order == F.col("lead"))
    found = save(copies.select("_id", "_key", "first", "_h", "_g", "leads", F.when(F.col("leads"), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id", "_key", "first"), F.col("salts"))).cast("int").alias("salt"), "salts"), places, twice)
    # the texts of repeated chunks only: one visit to each document that has some
    wanted = found.groupBy("_id", "_key").agg(F.collect_set(F.struct("first", "_h", "_g", "leads", "salt", "salts")).alias("want"))
    asked = _may_have(keyed, found.select("_key"), found.count())
    some = asked.join(wanted.withColumnsRenamed({"_id": "_i", "_key": "_k"}).hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))).select("_id", "_key", "text", "want").dropDuplicates(["_id", "_key"])
    by = F.map_from_entries(F.transform(line_chunks(F.col("text")), lambda c: F.struct(c["first"], c["text"])))
    # within one expression, so that a text is cut once for all its repeated chunks
    with_text = F.get(F.transform(F.array(by), lambda m: F.transform("want", lambda w: F.named_struct(F.lit("w"), w, F.lit("chunk"), F.element_at(m, w["first"])))), F.lit(0))
    exact = save(some.select("_id", "_key", F.explode(with_text).alias("x")).select("_id", "_key", "x.w.*", F.col("x.chunk").alias("chunk")), found)
    leads = exact.where("leads").dropDuplicates(["_h", "_g"]).select("_h", "_g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("chunk").alias("_same"))
    gone = exact.where("not leads").join(leads, ["_h", "_g", "salt"]).where(F.col("chunk").cast("binary") == F.col("_same").cast("binary"))
    return save(gone.groupBy("_id", "_key").agg(F.collect_set("first").alias("gone")), exact)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with repeated chunks cut out of text, and n_lines, removed_lines, removed_chunks.

    A text whose every chunk repeats becomes empty. Null texts stay null and have 0 lines; empty texts have 1. Long
    texts are handled whole. Columns of docs with the three names are replaced.
    """
    gone = repeated_chunks(docs.select("doc_id", "text"))
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_k"))
    joined = held.join(gone.hint("merge"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    cut = joined.withColumn("_c", F.when(F.col("gone").isNotNull(), line_chunks(F.col("_row.text"))))
    kept = F.filter("_c", lambda c: ~F.array_contains("gone", c["first"]))
    lost = F.filter("_c", lambda c: F.array_contains("gone", c["first"]))
    added = {
        "n_lines": F.coalesce(F.length("_row.text") - F.length(F.replace("_row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        "removed_lines": F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda s, c: s + c["n"]), F.lit(0).cast("long")),
        "removed_chunks": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    return cut.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def _windows(text: Column, least_words: int) -> Column:
    """array<struct<first, n, same>>: the shortest runs of lines of so many words from each line on and up to each line.

    Together they cover every line of a repeated run of so many words, and depend on nothing outside of it. A run begins
    and ends with a line that has words. same is the SHA-256 of the run's text.
    """

    def reach(ws: Column) -> Column:
        """For each line, words * 1000 + lines of the shortest run from it on; under least_words * 1000 if there is none."""
        full = F.lit(least_words * 1000)
        return F.transform(ws, lambda _, k: F.aggregate(F.slice(ws, k + 1, least_words), F.lit(0), lambda s, w: F.when(s >= full, s).otherwise(s + w * 1000 + 1)))

    def span(r: Column, at: Column, k: Column, ahead: bool) -> Column:
        far = F.pmod(r, F.lit(1000)) - 1
        a, b = (F.get(at, k), F.get(at, k + far)) if ahead else (F.get(at, k - far), F.get(at, k))
        return F.when(r >= least_words * 1000, a.cast("long") * 2**31 + (b - a + 1))

    counted = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.named_struct(F.lit("ls"), ls, F.lit("w"), F.transform(ls, lambda x: F.least(F.regexp_count(x, F.lit("[^ \\t\\n\\r]+")), F.lit(least_words)))))
    worded = F.transform(counted, lambda s: F.named_struct(F.lit("ls"), s["ls"], F.lit("w"), F.filter(s["w"], lambda w: w > 0), F.lit("at"), F.filter(F.transform(s["w"], lambda w, i: F.when(w > 0, i)), lambda i: i.isNotNull())))
    reached = F.transform(worded, lambda s: F.named_struct(F.lit("ls"), s["ls"], F.lit("at"), s["at"], F.lit("on"), reach(s["w"]), F.lit("up"), F.reverse(reach(F.reverse(s["w"])))))
    spans = F.transform(
        reached,
        lambda s: F.named_struct(
            *(F.lit("ls"), s["ls"]),
            *(F.lit("x"), F.filter(F.array_distinct(F.concat(F.transform(s["on"], lambda r, k: span(r, s["at"], k, True)), F.transform(s["up"], lambda r, k: span(r, s["at"], k, False)))), lambda x: x.isNotNull())),
        ),
    )

    def run(s: Column, x: Column) -> Column:
        first, n = F.shiftright(x, 31).cast("int"), F.pmod(x, F.lit(2**31)).cast("int")
        return F.named_struct(F.lit("first"), first, F.lit("n"), n, F.lit("same"), F.unhex(F.sha2(F.array_join(F.slice(s["ls"], first + 1, n), "\n").cast("binary"), 256)))

    return F.get(F.transform(spans, lambda s: F.transform(s["x"], lambda x: run(s, x))), F.lit(0))


def repeated_runs(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_id, _key, runs: array<struct<first, n>>): the runs of lines to remove, for rows that have any.

    Runs of least_words words or more are compared wherever they stand, shorter ones of least_lines lines or more as the
    chunks of line_chunks(). Texts with one SHA-256 count as equal, so no text is moved. A run that overlaps its first
    occurrence stays. _key and ids as in repeated_chunks().
    """
    keyed = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    short = F.filter(line_chunks(F.col("text")), lambda c: (c["n"] >= least_lines) & (F.regexp_count(c["text"], F.lit("[^ \\t\\n\\r]+")) < least_words))
    short = F.transform(short, lambda c: F.named_struct(F.lit("first"), c["first"], F.lit("n"), c["n"], F.lit("same"), F.unhex(F.sha2(c["text"].cast("binary"), 256))))
    places = save(keyed.select("_id", "_key", F.explode(F.concat(_windows(F.col("text"), least_words), short)).alias("c")).select("_id", "_key", "c.*"))
    order = F.struct(F.col("_id").isNull().alias("a"), F.coalesce("_id", F.lit(0)).alias("b"), F.col("_key").alias("k"), F.col("first").alias("f"))
    twice = save(places.groupBy("same").agg(F.min(order).alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m"))
    lead = F.col("lead")
    apart = (order["a"] != lead["a"]) | (order["b"] != lead["b"]) | (order["k"] != lead["k"]) | (F.col("first") >= lead["f"] + F.col("n"))
    return save(places.join(twice, "same").where(apart).groupBy("_id", "_key").agg(F.collect_set(F.struct("first", "n")).alias("runs")), places, twice)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with repeated_runs() cut out of text, and n_lines, removed_lines, removed_passages.

    A passage is a longest run of removed lines. Else as dedup_lines().
    """
    gone = repeated_runs(docs.select("doc_id", "text"))
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_k"))
    joined = held.join(gone.hint("merge"), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    lost = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))))
    cut = joined.withColumn("_x", F.when(F.col("runs").isNotNull(), lost)).withColumn("_n", F.coalesce(F.length("_row.text") - F.length(F.replace("_row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)))
    # set operations on ints are hashed, so that long texts cost no more a line
    kept = F.transform(F.array(F.split("_row.text", "\n", -1)), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_x")), lambda i: F.get(ls, i)), "\n"))
    added = {
        "n_lines": F.col("_n").cast("long"),
        "removed_lines": F.coalesce(F.size("_x"), F.lit(0)).cast("long"),
        "removed_passages": F.coalesce(F.size(F.array_except("_x", F.transform("_x", lambda i: i + 1))), F.lit(0)).cast("long"),
    }
    text = F.when(F.col("_x").isNull(), F.col("_row.text")).otherwise(F.get(kept, F.lit(0)))
    return cut.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
