"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Two lines within `edits` edits of each other leave at least one of edits + 1
disjoint segments untouched, and an untouched one exists that lies at most
i - 1 places from where it would be counted from the left, if it is the i-th,
and at most edits + 1 - i places counted from the right. So a line indexes its
segments, and probes for other lines' segments with substrings at those few
shifts, counted from the nearer end. Segments are laid out by length class, so
that lines of nearly the same length have the same layout; a line close below
a class boundary belongs to both classes. Candidates are verified by banded
bit-parallel edit distance on what is left without common prefix and suffix.

Many lines can share a segment and be far apart. So a key is made finer by the
lines' parities, 64 bits that tell whether characters with each hash are odd in
number: an edit flips two of them at most, so of 2 * edits + 1 stretches of the
bits one is equal, and lines meet under a key with an equal stretch only.

Classes of lines are the components of equal and linked lines; the first line
of a class, by document and place, stays. Components need some of the links
only, and links.py finds as many without making all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of, written
from docloom.llm.links import linked

CLASS_WIDTH, LONG, LONG_WIDTH = 8, 128, 32  # length classes are wider from LONG characters on
BLANKS = " \t\n\x0b\x0c\r"


def _slots(edits: int) -> list[tuple[int, int]]:
    """Which segment, from 1, and which shift each key of a line is for."""
    reach = lambda i: min(i - 1, edits + 1 - i)
    return [(i, shift) for i in range(1, edits + 2) for shift in range(-reach(i), reach(i) + 1)]


def segment_keys(lines: DataFrame, ranges: list[tuple[int, Column]]) -> DataFrame:
    """lines has h1 and line; ranges gives numbers of edits, the greatest first,
    and which lengths (by a condition on n) they are for. Gives key and h1: keys
    are even hashes of segments, plus one where the segment is the line's own
    and no probe. A key can come twice for a line."""
    rows = lines.withColumn("n", F.length("line"))
    width = F.when(F.col("n") < LONG, CLASS_WIDTH).otherwise(LONG_WIDTH)
    cls = F.col("n") - F.col("n") % width  # the least length of the class
    laid = []
    for edits, wanted in ranges:
        layout = lambda c: F.struct(F.lit(edits).alias("edits"), c.alias("cls"))  # noqa: B023,E731
        next_too = F.when(F.col("n") % width >= width - edits, F.array(layout(cls), layout(cls + width))).otherwise(F.array(layout(cls)))
        laid.append(F.when(wanted, next_too).otherwise(F.slice(next_too, 1, 0)))
    rows = rows.select("h1", "line", "n", F.inline(F.concat(*laid)))
    rows = rows.where(F.col("cls") > F.col("edits")).withColumn("size", F.floor((F.col("cls") - F.col("edits")) / (F.col("edits") + 1)).cast("int"))

    def placed(edits: int, i: int, shift: int) -> Column:
        left, right = i - 1, edits + 1 - i
        start = F.col("size") * left if left <= right else F.col("n") - F.col("size") * (right + 1)
        return F.struct((start + shift + 1).alias("start"), F.lit(8 * edits + i).alias("seed"), F.lit(int(shift == 0)).alias("own"))

    slots = [[placed(edits, *(own[k] if k < len(own) else own[0])) for k in range(len(_slots(ranges[0][0])))] for edits, _ in ranges for own in [_slots(edits)]]
    keys = []
    for at in zip(*slots):  # one hash for all ranges, or the code is too long to be compiled
        pick = lambda f: at[0][f] if len(at) == 1 else F.when(F.col("edits") == ranges[0][0], at[0][f]).otherwise(at[1][f])  # noqa: B023,E731
        keys.append(F.xxhash64(F.substring(F.col("line"), pick("start"), F.col("size")), F.col("cls"), pick("seed")).bitwiseAND(F.lit(-2)).bitwiseOR(pick("own")))
    rows = rows.select("h1", F.array(*keys).alias("keys"))  # a projection of its own, so that it is compiled
    return rows.select("h1", F.explode_outer("keys").alias("key"))  # outer, or the keys are made a second time to see that there are any


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by steps of falling powers of two."""
    most = F.least(F.length(a), F.length(b))
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda p: p <= most)
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when((n + p <= most) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p)), n + p).otherwise(n))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of a and b if it is at most edits, else a greater number.

    Bit k of a column stands for row column - edits + k of the table whose
    columns are the characters of the shorter string: the vertical steps of 2 *
    edits + 1 cells along the diagonal. D0 tells where the diagonal step is 0.
    """
    ordered = F.when(F.length(a) >= F.length(b), F.struct(a.alias("x"), b.alias("y"))).otherwise(F.struct(b.alias("x"), a.alias("y")))
    parts = let(ordered, lambda o: F.struct(F.split(o["x"], "").alias("rows"), F.split(o["y"], "").alias("columns"), F.length(o["y"]).alias("n"), (F.length(o["x"]) - F.length(o["y"])).alias("more")))
    return let(parts, lambda z: _banded(z["rows"], z["columns"], z["n"], z["more"], edits))


def _banded(rows: Column, columns: Column, n: Column, more: Column, edits: int) -> Column:
    width, top = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    inv = lambda x: x.bitwiseXOR(F.lit(top))
    both = lambda x, y: x.bitwiseAND(y)
    either = lambda x, y: x.bitwiseOR(y)

    def step(s: Column, j: Column) -> Column:
        c = F.get(columns, j - 1)
        same = sum((F.when(F.coalesce(F.get(rows, F.when(j - 1 - edits + k >= 0, j - 1 - edits + k).otherwise(-1)) == c, F.lit(False)), 1 << k).otherwise(0) for k in range(width)), F.lit(0))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), same.alias("eq"))

    def advance(s: Column) -> Column:
        d0 = either(either(both((both(s["eq"], s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]), F.lit(top)), s["eq"]), s["vn"])
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), d0.alias("eq"))

    def settle(s: Column) -> Column:
        d0 = s["eq"]
        hp, hn = either(s["vn"], inv(either(d0, s["vp"]))), both(d0, s["vp"])
        down = F.shiftright(d0, 1)
        score = s["score"] + F.when(both(d0, F.lit(1 << edits)) == 0, 1).otherwise(0)
        return F.struct(either(hn, inv(either(down, hp))).alias("vp"), both(hp, down).alias("vn"), score.alias("score"), F.lit(0).alias("eq"))

    # the three parts of a column follow each other, so that each is evaluated once
    first = F.struct(F.lit(top & ~((1 << edits) - 1)).alias("vp"), F.lit((1 << edits) - 1).alias("vn"), F.lit(0).alias("score"), F.lit(0).alias("eq"))
    tick = F.when(n > 0, F.sequence(F.lit(0), 3 * n - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(tick, first, lambda s, i: F.when(i % 3 == 0, step(s, F.floor(i / 3).cast("int") + 1)).when(i % 3 == 1, advance(s)).otherwise(settle(s)))
    below = lambda s: sum((F.when(more > k, F.shiftright(s["vp"], edits + k).bitwiseAND(1) - F.shiftright(s["vn"], edits + k).bitwiseAND(1)).otherwise(0) for k in range(edits)), F.lit(0))
    return F.when(more > edits, edits + 1).otherwise(let(last, lambda s: s["score"] + below(s)))


def interior_fits(x: Column, y: Column, edits: int) -> Column:
    """False only if x and y, which differ at both ends, cannot be within two
    edits: then one edit is at each end, and what lies between is equal but for
    a shift of one. Of more edits it says nothing."""
    if edits > 2:
        return F.lit(True)
    inner = F.least(F.length(x), F.length(y)) - 4
    equal = [F.substring(x, F.lit(3), inner) == F.substring(y, F.lit(3 + shift), inner) for shift in (-1, 0, 1)]
    return (inner <= 0) | equal[0] | equal[1] | equal[2]


def within(pairs: DataFrame, edits: Column, most: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose lines are within edits of each other;
    edits is a number for each pair, most at the most."""
    cut_front = lambda x, y: let(common_prefix(x, y), lambda p: F.struct(F.substring(x, p + 1, F.length(x)).alias("x"), F.substring(y, p + 1, F.length(y)).alias("y")))
    cut_back = lambda x, y: let(common_prefix(F.reverse(x), F.reverse(y)), lambda p: F.struct(F.substring(x, F.lit(1), F.length(x) - p).alias("x"), F.substring(y, F.lit(1), F.length(y) - p).alias("y")))
    core = let(cut_front(F.col("la"), F.col("lb")), lambda c: cut_back(c["x"], c["y"]))
    distance = let(core, lambda c: F.when(interior_fits(c["x"], c["y"], most), banded_distance(c["x"], c["y"], most)).otherwise(most + 1))
    return pairs.where((F.abs(F.length("la") - F.length("lb")) <= edits) & (distance <= edits)).select("a", "b")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), pos, line, h1 (an even number) and h2
    (hashes of the line) of each line that is not blank."""
    rows = columns_free_of(docs, "doc_id", "text").where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.ltrim(F.col("line"), F.lit(BLANKS)) != "").withColumn("h1", F.xxhash64("line").bitwiseAND(F.lit(-2))).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def parities(line: Column) -> Column:
    """sign and sign2, 64 bits each: whether characters, and pairs of neighbours,
    with each hash are odd in number. An edit flips two of the first at most,
    four of the second."""
    odd = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))
    codes = F.transform(F.split(line, ""), F.ascii)
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    pairs = lambda c: F.zip_with(c, after(c), lambda x, y: x * 29 + F.coalesce(y, F.lit(0)) * 7)
    return let(codes, lambda c: F.struct(odd(c).alias("sign"), odd(pairs(c)).alias("sign2")))


def named(h1: str = "h1", h2: str = "h2") -> Column:
    """A line's item: both of its hashes."""
    return F.concat_ws("-", F.hex(h1), F.hex(h2))


def line_components(docs: DataFrame, edits: int, min_chars: int, short_chars: int | None = None) -> DataFrame:
    """Components (item, component) of lines that are linked to others by few
    edits. With short_chars, one edit links lines of which the shorter has
    short_chars characters or more but less than min_chars."""
    for few, least in [(edits, min_chars)] + ([] if short_chars is None else [(1, short_chars)]):
        width = CLASS_WIDTH if least < LONG else LONG_WIDTH
        if (least - least % width - few) // (few + 1) <= few:
            raise ValueError("segments of the shortest lines would be shorter than the shifts")
    lines, n = lines_of(docs), F.col("n")
    ranges = [(edits, n >= min_chars)] + ([] if short_chars is None else [(1, n.between(short_chars, min_chars))])
    keys = segment_keys(lines.select("h1", "line"), ranges).select(F.col("key").bitwiseAND(F.lit(-2)).alias("g"), F.col("h1").bitwiseOR(F.col("key").bitwiseAND(F.lit(1))).alias("hk"))
    keys = keys.repartition("g")  # one exchange for both sides of the join, which look at the same columns
    h1 = F.col("hk").bitwiseAND(F.lit(-2))
    # keys of several lines, one of which has it as a segment of its own
    shared = keys.groupBy("g").agg(F.min(h1).alias("lo"), F.max(h1).alias("hi"), F.max(F.col("hk").bitwiseAND(F.lit(1))).alias("own")).where("own = 1 and lo <> hi").select("g")
    groups = written(keys.join(shared.hint("shuffle_hash"), "g").select("g", h1.alias("h1")).distinct(), "groups")
    known = lines.join(groups.select("h1").distinct(), "h1", "left_semi").select(named().alias("item"), "h1", "line").dropDuplicates(["item"])
    known = written(known.select("item", "h1", "line", F.length("line").alias("n"), parities(F.col("line")).alias("p")).select("item", "h1", "line", "n", "p.*"), "texts")

    # finer keys: the parity bits of one stretch of 2 * edits + 1
    stretches = 2 * edits + 1
    mask = (1 << (64 // stretches)) - 1
    bits = F.array(*[F.shiftrightunsigned("sign", i * (64 // stretches)).bitwiseAND(F.lit(mask)) for i in range(stretches)])
    told = groups.join(known.select("item", "h1", "n", "sign", "sign2"), "h1")
    fine = told.select("item", "n", "sign", "sign2", "g", F.posexplode(bits).alias("i", "bits")).select(F.xxhash64("g", "i", "bits").alias("g"), "item", "n", "sign", "sign2")
    several = fine.groupBy("g").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("g")
    fine = written(fine.join(several, "g").distinct(), "finer")

    allowed = lambda x, y: F.lit(edits) if short_chars is None else F.when(F.least(x, y) < min_chars, 1).otherwise(edits)
    flips = lambda x, y, c: F.bit_count(x[c].bitwiseXOR(y[c]))
    near = lambda x, y: (lambda e: (F.abs(x["n"] - y["n"]) <= e) & (flips(x, y, "sign") <= 2 * e) & (flips(x, y, "sign2") <= 4 * e))(allowed(x["n"], y["n"]))

    def verify(pairs: DataFrame) -> DataFrame:
        left = known.select(F.col("item").alias("a"), F.col("line").alias("la"))
        right = known.select(F.col("item").alias("b"), F.col("line").alias("lb"))
        return within(pairs.join(left, "a").join(right, "b"), allowed(F.length("la"), F.length("lb")), edits)

    return linked(fine, verify, near)[0]


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = 40, short_chars: int | None = None, classes: bool = True) -> DataFrame:
    """docs with text cut to the lines that stay, and more columns: n_lines and
    n_removed (lines, blank ones not counted), and with classes n_links, how
    many of the document's lines are linked to a line with another text, and
    class_docs and class_places, the document and place of the first line of
    the class of each line that is not blank, in order (null for a null text).

    Lines end at a newline. A line is removed if a line of its class comes
    earlier in the corpus: in a smaller doc_id, or at an earlier place of the
    same one. Blank lines stay. Lines of min_chars characters or more are of
    one class with lines within `edits` edits, shorter ones with equal lines
    only, or, with short_chars and from there on, with lines within one edit.
    A class holds all that chains of links reach. A null text stays null; a
    null doc_id counts as the smallest; rows that share a doc_id are rivals by
    place, and repeated rows are treated alike. An empty table stays empty.
    Other columns are kept as they are, but for those named like the new ones.
    """
    parts = line_components(docs, edits, min_chars, short_chars)
    slim = lines_of(docs).select("doc_id", "th", "pos", "h1", "h2", named().alias("item")).join(parts, "item", "left")
    slim = slim.select("doc_id", "th", "pos", *[F.when(F.col("component").isNull(), F.col(h)).otherwise(F.xxhash64(F.lit(i), "component")).alias(c) for i, (c, h) in enumerate([("c1", "h1"), ("c2", "h2")])], F.col("component").isNotNull().alias("far"))
    slim = written(slim, "classes")
    # a class's first line; classes of more lines than a fair share of a task meet it where they are
    first = written(slim.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    share = int(first.agg(F.sum("n")).first()[0] or 0) // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    hot, other = first.where(F.col("n") > share).drop("n"), first.where(F.col("n") <= share).drop("n")  # no more hot ones than four for each partition
    met = slim.join(F.broadcast(hot), ["c1", "c2"]).unionByName(slim.join(F.broadcast(hot.select("c1", "c2")), ["c1", "c2"], "left_anti").join(other, ["c1", "c2"]))
    told = met.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "far", "first"))).alias("__told"))  # of one document
    # repeated rows give each place several times, and collect_set one of them
    extra = told.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__told")
    keyed = docs.withColumn("__id0", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__th0", F.xxhash64("text"))
    joined = keyed.join(extra, (F.col("__id0") == F.col("__id")) & (F.col("__th0") == F.col("__th")), "left")
    late = F.filter("__told", lambda x: (x["first"]["doc_id"] < F.col("__id0")) | (x["first"]["pos"] < x["pos"]))
    joined = joined.withColumn("__gone", F.coalesce(late["pos"], F.array().cast("array<int>")))
    joined = joined.withColumn("__lines", F.split("text", "\n", -1))  # by a name of its own, for a new text is selected beside it
    lines = F.col("__lines")
    n_gone, n_all = F.size("__gone"), F.size(lines)
    # places are read one by one; an array of all of them, made from another, would be made again for each
    gone = (lambda k: F.get("__gone", k), n_gone)
    begin = lambda places, k: F.when(k == 0, 0).otherwise(places[0](k - 1) + 1)  # noqa: E731, of the stretch before the k-th place
    until = lambda places, k: F.when(k == places[1], n_all).otherwise(places[0](k))
    none = F.array().cast("array<int>")
    stretch = lambda places, k: F.when(begin(places, k) < until(places, k), F.sequence(begin(places, k), until(places, k) - 1)).otherwise(none)  # noqa: E731, places in it
    # the stretches between the places that go: each line is looked at once
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n_gone), lambda k: F.transform(stretch(gone, k), lambda i: F.get(lines, i))))
    text = F.when(n_gone == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    blank = lambda x: F.ltrim(x, F.lit(BLANKS)) == ""
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: ~blank(x))), F.lit(0)).cast("long")
    added = [n_lines.alias("n_lines"), F.size("__gone").cast("long").alias("n_removed")]
    if classes:
        joined = joined.withColumn("__told", F.coalesce("__told", F.from_json(F.lit("[]"), extra.schema["__told"].dataType)))
        known = (lambda k: F.get("__told", k)["pos"], F.size("__told"))
        own = lambda i: F.struct(F.col("__id0").alias("doc_id"), i.alias("pos"))
        alone = lambda k: F.transform(F.filter(stretch(known, k), lambda i: ~blank(F.get(lines, i))), own)
        last = lambda k: F.when(k < F.size("__told"), F.array(F.get("__told", k)["first"])).otherwise(F.slice(F.transform("__told", lambda x: x["first"]), 1, 0))
        listed = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__told")), lambda k: F.concat(alone(k), last(k))))
        joined = joined.withColumn("__firsts", F.when(lines.isNotNull(), listed))
        firsts = F.col("__firsts")
        n_links = F.coalesce(F.size(F.filter("__told", lambda x: x["far"])), F.lit(0)).cast("long")
        added += [n_links.alias("n_links"), F.transform(firsts, lambda x: x["doc_id"]).alias("class_docs"), F.transform(firsts, lambda x: x["pos"]).alias("class_places")]
    new = {"n_lines", "n_removed"} | ({"n_links", "class_docs", "class_places"} if classes else set())
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in new], *added)
