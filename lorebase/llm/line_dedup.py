"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes where an earlier line of the corpus has a Jaccard similarity of LEAST or more with it, judged
on the input: lines that go themselves count as earlier lines too. The order is that of documents (by id, null last, then
by a hash of the text), then of lines. Lines without words are not judged and stay.

Equal lines are one entry with its first place. Words are ordered by rarity (counts over all lines, in a table of 65,536
hashed places, so its size is fixed; ties by hash). The first word in that order that two similar lines share is among the first
n / 5 + 1 words of the longer line and the first n / 9 + 1 of the shorter, so the longer line's list meets the shorter line's. A word that
stands in more than HEAVY lines is joined on together with the next shared word, which is at most one place further on, so lists don't grow
with the corpus as words do. Lists are made by plain explodes, without higher-order functions, which would end code generation. Lengths, places in the order and parity signatures rule out more (and no similar pair). The
word sets themselves are then compared, as 64-bit hashes of their words. In a first pass each line meets the earliest line of each of its lists, which
settles the lines of large groups; two settled lines never meet again.

Lines are told apart by two 64-bit hashes, documents by their id and a 64-bit hash of their text.

Null texts have no lines. Rows with equal id and text are documents one after the other: of those behind the first, all lines with words
go. Empty tables give no rows. Further columns pass through dedup_lines() untouched. DataFrame functions alone are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, drop_table, few, materialize, no_dictionary

#: Similarity is 4 / 5; whole numbers keep the comparison exact.
OVER, UNDER = 4, 5
_PLACES = 1 << 16
#: Words above which a line has a second signature; lines with a word (as its place counts them) above which the word is joined on with another one.
_LONG, HEAVY = 80, 1 << 14
#: Lines of a key up to which they all meet; those of longer lists meet the earliest one first.
CROWD = 256
#: Classes of keys that are joined one after the other, so that a third of all lists is shuffled at a time, whatever the input's size.
PARTS = 3
_LAST = (1 << 63) - 1
#: Turns the bits of the keys of one side into those of another.
_SIDE = 0x5851F42D4C957F2D
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _spaced(text: Column) -> Column:
    """The text with a blank for each other white space but the line feed; most texts have none and aren't rewritten."""
    spaces = "\t\x0b\x0c\r"
    found = reduce(Column.__or__, (F.contains(text, F.lit(space)) for space in spaces))
    return F.when(found, reduce(lambda x, space: F.replace(x, F.lit(space), F.lit(" ")), spaces, text)).otherwise(text)


def _words(line: Column) -> Column:
    """The words of a line of _lines(), and empty strings."""
    return F.split(line, " ")


def _hashes(line: Column) -> Column:
    """The 64-bit hashes of the distinct words of a line of _lines()."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _places(df: DataFrame) -> DataFrame:
    """df's (doc, rid): the id (null last), and a hash of the id and the text."""
    return df.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "rid": F.xxhash64("doc_id", "text")})


def _lines(df: DataFrame, rows: bool = False) -> DataFrame:
    """(doc, rid, pos, line, lid, lid2) of each line with a word, lines counted from 1, blanks for its white space. rows: and an entry 0 for each row that has a text."""
    split = F.split(_spaced(F.col("text")), "\n")
    d = _places(df).select("doc", "rid", F.posexplode(F.concat(F.array(F.lit("")), split) if rows else split).alias("pos", "line"))
    d = d if rows else d.withColumn("pos", F.col("pos") + 1)
    row = F.col("pos") == 0
    d = d.where(row | (F.trim("line") != ""))
    return d.withColumns({"lid": F.when(row, F.col("rid")).otherwise(F.xxhash64("line")), "lid2": F.when(row, F.col("doc")).otherwise(F.xxhash64(F.lit(1), "line"))})


def _place_of(h: Column) -> Column:
    return h.bitwiseAND(_PLACES - 1).cast("int")


def _rarity(distinct: DataFrame) -> tuple[Column, int, int]:
    """The rank of each hashed place by the count of its words, rarest first, in the upper half of an integer, as a constant array; and the
    first of these that is heavy, and that has more than CROWD words."""
    words = distinct.select(F.explode(_words(F.col("line"))).alias("w"))
    counts = dict(words.select(_place_of(F.xxhash64("w")).alias("place")).groupBy("place").count().collect())  # at most 65,536 rows
    order = sorted(range(_PLACES), key=lambda p: (counts.get(p, 0), p))
    ranks = [0] * _PLACES
    for rank, place in enumerate(order):
        ranks[place] = (rank - _PLACES // 2) << 16
    above = lambda most: (sum(counts.get(p, 0) <= most for p in order) - _PLACES // 2) << 16
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>"), above(HEAVY), above(CROWD)


def _prefix(n: str, over: int, under: int) -> Column:
    """Words of n among which the first shared one is, where over / under of them are shared."""
    return F.expr(f"{n} - ({over} * {n} + {under - 1}) div {under} + 1").cast("int")


def _marks(distinct: DataFrame, ranks: Column) -> DataFrame:
    """(lid, lid2, doc, n, sig, sig2, keys) of each line: keys are its first words in order of rarity, and one more.

    A signature has a bit for each of 64 hashed classes of words, set where the line has an odd number of them. Each word that
    two lines don't share changes one bit at most. Long lines also have the signature of one half of all words, which gives that of the
    other half, and so 128 classes.
    """
    # few steps for each word, as they are interpreted; coalesce() says that none is null, so that plain integers are sorted
    d = distinct.select("lid", "lid2", "doc", _hashes(F.col("line")).alias("h"))
    key = F.transform("h", lambda h: F.coalesce(ranks[h.bitwiseAND(_PLACES - 1)].bitwiseOR(F.shiftrightunsigned(h, 48).cast("int")), F.lit(0)))
    d = d.select("lid", "lid2", "doc", F.size("h").alias("n"), key.alias("keys"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)  # noqa: E731  (modulo 64)
    sig = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))
    half = F.filter("keys", lambda k: k.bitwiseAND(64) != 0)
    sig2 = F.when(F.col("n") > _LONG, sig(half)).otherwise(F.lit(0).cast("long"))
    d = d.select("lid", "lid2", "doc", "n", sig("keys").alias("sig"), sig2.alias("sig2"), F.sort_array("keys").alias("keys"))
    return d.withColumn("keys", F.slice("keys", F.lit(1), _prefix("n", OVER, UNDER) + 1))


def _postings(marks: DataFrame, heavy: int, part: int | None, short: bool, *more: str) -> DataFrame:
    """(key, lid, doc, place, sig, sig2, *more) for one of PARTS classes of keys, or all; place is n and the word's place among the line's, in one number, as each column
    takes 8 bytes of a shuffle's rows. short: of the words that a line shares with longer ones."""
    length = _prefix("n", 2 * OVER, OVER + UNDER) if short else _prefix("n", OVER, UNDER)
    own = ("lid", "doc", "sig", "sig2", *more)
    d = marks.select(*own, "n", "keys", length.alias("length"))
    d = d.select(*own, "n", "keys", "length", F.posexplode(F.slice("keys", F.lit(1), F.col("length"))).alias("at", "word"))
    d = d if part is None else d.where(F.pmod("word", F.lit(PARTS)) == part)
    # a heavy word goes with each word behind it, up to the first that isn't in the prefix
    alone = (F.col("word") < heavy) | (F.col("n") == 1)
    beside = F.when(alone, F.lit([0]).cast("array<int>")).otherwise(F.slice("keys", F.col("at") + 2, F.col("length") - F.col("at")))
    d = d.select(*own, "n", "at", "word", alone.alias("alone"), F.explode(beside).alias("beside"))
    second = F.when(F.col("alone"), F.lit(0).cast("long")).otherwise(F.lit(1 << 31) + F.col("beside"))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return d.select((F.col("word").cast("long") * (1 << 32) + second).alias("key"), place.alias("place"), *own)


def _may_match(x: str, y: str) -> Column:
    """The length filter, the positional filter at the first shared word (one word and all after it must be able to give the overlap), and the signatures: what isn't shared may be a ninth of both lines."""
    (a, i), (b, j) = ((F.shiftright(p, 32), p.bitwiseAND((1 << 32) - 1)) for p in (F.col(f"{x}place"), F.col(f"{y}place")))
    overlap = 1 + F.least(a - i - 1, b - j - 1)
    most = (UNDER - OVER) * (a + b)
    bits = lambda c: F.bit_count(c) * (OVER + UNDER)
    whole, half = (F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}")) for s in ("sig", "sig2"))
    apart = (bits(whole) <= most) & ((F.least(a, b) <= _LONG) | (bits(half) + bits(whole.bitwiseXOR(half)) <= most))
    return (UNDER * a >= OVER * b) & (UNDER * b >= OVER * a) & ((OVER + UNDER) * overlap >= OVER * (a + b)) & apart


def _verified(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(lid, lid2) of the later line of each pair (x, y) whose word sets are similar enough."""
    pairs = materialize(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("x").alias("lid")).union(pairs.select("y")).distinct()
    needed = distinct.join(F.broadcast(ids) if pairs.count() <= FEW else ids, "lid", "left_semi")
    # word sets as 64-bit hashes: whole numbers are compared without strings
    needed = materialize(needed.select("lid", _hashes(F.col("line")).alias("w"), F.struct("doc", "rid", "pos", "lid", "lid2").alias("o")), "needed")
    side = lambda c: needed.select(F.col("lid").alias(c), F.col("w").alias(f"{c}_w"), F.col("o").alias(f"{c}_o"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    shared = F.size(F.array_intersect("x_w", "y_w"))
    similar = met.where((OVER + UNDER) * shared >= OVER * (F.size("x_w") + F.size("y_w")))
    later = materialize(similar.select(F.greatest("x_o", "y_o").alias("o")).select("o.lid", "o.lid2").distinct(), "later")
    drop_table(pairs, needed)
    return later


def _in_parts(pairs_of: Callable[[int | None], DataFrame], distinct: DataFrame, at_once: bool = False) -> DataFrame:
    """The later lines of the pairs of all classes of keys, found one class after the other, or at once."""
    parts = [materialize(pairs_of(part), "part") for part in ([None] if at_once else range(PARTS))]
    later = _verified(reduce(DataFrame.union, parts), distinct)
    drop_table(*parts)
    return later


def _removed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, rid, pos) of the lines that go, each first row of its id and text taken for itself; and (doc, rid) of rows that are repeated."""
    entries = _lines(df, rows=True).groupBy("lid", "lid2").agg(F.min(F.struct("doc", "rid", "pos", "line")).alias("f"), F.count("*").alias("copies"))
    entries = materialize(entries.select("lid", "lid2", "f.*", "copies").where("pos > 0 OR copies > 1"), "lines")
    distinct = entries.where("pos > 0")
    ranks, heavy, crowded = _rarity(distinct)
    with no_dictionary(df.sparkSession):
        marks = materialize(_marks(distinct, ranks), "marks")
    # keys whose lists are long; those of the other keys meet each other whole. A list has no more lines than its word's place has words
    hot = materialize(_postings(marks, heavy, None, True).where(F.shiftright("key", 32) >= crowded).groupBy("key").count().where(F.col("count") > CROWD), "hot")
    n_hot, n_listed = hot.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    n_all = marks.agg(F.coalesce(F.sum(_prefix("n", 2 * OVER, OVER + UNDER)), F.lit(0))).first()[0]
    hot_keys = few(hot.select("key", F.lit(True).alias("hot")))
    by_word = Window.partitionBy("key").orderBy("doc", "lid").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_lead(part: int | None) -> DataFrame:
        # the words that two lines of one length must share one of; which of a group's lines meet their lead first doesn't matter
        listed = _postings(marks, heavy, part, True).join(hot_keys, "key", "left_semi").withColumn("lead", F.first(F.struct("lid", "place", "sig", "sig2")).over(by_word)).where("lead.lid <> lid")
        return listed.select("*", *(F.col(f"lead.{c}").alias(f"y_{c}") for c in ("place", "sig", "sig2"))).where(_may_match("", "y_")).select(F.col("lid").alias("x"), F.col("lead.lid").alias("y"))

    if n_hot:
        settled = _in_parts(with_lead, distinct, n_listed * PARTS <= n_all)
        known = marks.join(few(settled.withColumn("settled", F.lit(True))), ["lid", "lid2"], "left").withColumn("settled", F.col("settled").isNotNull())
        # written, as each class of keys reads it twice
        with no_dictionary(df.sparkSession):
            known = materialize(known, "known")
        drop_table(marks)
    else:
        settled = materialize(distinct.select("lid", "lid2").limit(0), "later")
        known = marks.withColumn("settled", F.lit(False))

    def met(part: int | None) -> DataFrame:
        # by keys with long lists, open lines meet all shorter ones on side 0, and settled lines meet the open shorter ones on side 1, which is told by the
        # key; by other keys all meet
        def side(short: bool, s: str) -> DataFrame:
            d = _postings(known, heavy, part, short, "settled")
            if n_hot:
                both = F.lit([0, _SIDE]).cast("array<bigint>")
                sides = (F.when(F.col("hot") & ~F.col("settled"), both) if short else F.when(F.col("hot") & F.col("settled"), F.slice(both, 2, 1))).otherwise(F.slice(both, 1, 1))
                d = d.join(hot_keys, "key", "left").withColumn("side", F.explode(sides)).withColumn("key", F.col("key").bitwiseXOR(F.col("side")))
            return d.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("lid", "place", "sig", "sig2")))

        x, y = side(False, "x"), side(True, "y")
        x_n, y_n = (F.shiftright(f"{s}_place", 32) for s in "xy")
        once = (x_n > y_n) | ((x_n == y_n) & (F.col("x_lid") > F.col("y_lid")))
        return x.join(y, "key").where(once & _may_match("x_", "y_")).select(F.col("x_lid").alias("x"), F.col("y_lid").alias("y"))

    late = settled.union(_in_parts(met, distinct)).distinct()
    late = late.withColumn("late", F.lit(True))
    first = distinct.select("lid", "lid2", *(F.col(c).alias(f"f_{c}") for c in ("doc", "rid", "pos")), "copies")
    place = materialize(first.join(late, ["lid", "lid2"], "left").where("copies > 1 OR late").drop("copies"), "places")
    repeated = materialize(entries.where("pos = 0").select("doc", "rid"), "repeated")
    drop_table(entries, known, settled, hot)
    again = F.col("late").isNotNull() | (F.struct("doc", "rid", "pos") != F.struct("f_doc", "f_rid", "f_pos"))
    gone = _lines(df).select("doc", "rid", "pos", "lid", "lid2").join(few(place), ["lid", "lid2"]).where(again).select("doc", "rid", "pos")
    return gone, repeated


def dedup_lines(df: DataFrame) -> DataFrame:
    """df with the text of the lines that stay, and n_lines_before, n_lines_removed."""
    found, repeated = _removed(df)
    gone = few(materialize(found.groupBy("doc", "rid").agg(F.collect_set("pos").alias("gone")), "gone"))
    whole = _places(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), "doc_id", "text")).select("_row", "doc", "rid")
    met = whole.join(gone, ["doc", "rid"], "left")
    met = met.withColumn("_lines", F.split("_row.text", "\n")).withColumn("_worded", F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_lines", i - 1).rlike(_HAS_WORD)))
    if repeated.limit(1).count():
        again = met.join(few(repeated), ["doc", "rid"], "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("doc", "rid").orderBy(F.xxhash64("_row"))))
        again = again.withColumn("gone", F.when(F.col("_nth") > 1, F.col("_worded")).otherwise(F.col("gone"))).drop("_nth")
        met = met.join(few(repeated), ["doc", "rid"], "left_anti").unionByName(again)
    kept = F.array_except(F.sequence(F.lit(1), F.size("_lines")), "gone")
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i - 1)), "\n"))
    met = met.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return met.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns), F.coalesce(F.size("_worded"), F.lit(0)).cast("long").alias("n_lines_before"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_lines_removed"))


def line_dedup_report(df: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document."""
    d = dedup_lines(df.select("doc_id", "text"))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col("n_lines_before"), F.lit(0)).alias("n_lines"), F.greatest(F.col("n_lines_removed"), F.lit(0)).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
