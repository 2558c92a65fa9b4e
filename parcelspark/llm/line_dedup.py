"""Line deduplication by a segment-partition edit join, DataFrame functions only.

Lines (split at line feeds, white space at both ends deleted) are duplicates when equal, or when both have ``MIN_CHARS`` characters or more and lie
within ``EDITS`` = tau edits. Exact copies are combined first, on the map side too, so a line that a third of all documents hold is one row from there on; each
different line gets a number of its own. The join:

1. A line of length n is cut into tau + 1 segments, of which tau edits leave one whole. So a line of length m finds it by that segment among
   its own substrings, for each n from m - tau to m and only at the starts that tau edits allow (those that leave at most i - 1 edits before the
   i-th segment and tau + 1 - i after it). Segments and substrings meet in an equi-join on a hash of segment number and characters.
2. A segment that more than ``CROWD`` lines have, such as one of a text with many altered copies or the fixed part of a template, would bring all of them together. Lines
   with such a segment (and those that find it) are compared apart from the others: they are cut into ``PARTS`` parts, of which tau edits damage tau at most, and meet by a hash of all
   parts but tau, for each choice of those and each way in which tau edits can move what lies between. So lines of a crowd meet only where most of both is the same, and where they have about as many of each frequent character.
   A key that is still crowded, such as a template around its number, is followed by what is left of both lines without it, a third of them for two edits, in the same way. Rests of ``SHORT`` characters or
   fewer meet by what is left after deletions (tau of the longer, as many less of the shorter as it is shorter), with their edit distance looked at right there.
3. Of lines that meet, lengths must be within tau, and tau edits change the counts of letters by 2 tau at most. The rest is verified by edit distance, computed in a band of 2 tau + 1 diagonals with bit-parallel column steps.
4. Links make connected classes, of which the first line (least document id, then line number) stays.

What lines share with many others (first and last, class) comes back to their occurrences by joins that adaptive execution splits. The lines of
candidates are fetched by a broadcast of their numbers if there are at most ``broadcast_rows`` (counted), and by a shuffled join beyond.

Defined results: null texts have no lines; blank lines are never duplicates and stay; a null id orders last. Repeated documents count as further
occurrences at the same place, of which all or none stay. An empty table gives an empty result; further columns are ignored by ``classes`` and kept by
``drop_duplicate_lines``, whatever their names. Lines, pairs and links are written to the shared folder while the plan is made.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, digest, free_names, row_key, written

EDITS, MIN_CHARS = 2, 20
#: Lines that may share a segment before they are compared by more of what they hold, and a quarter of those that may share all parts but a few; any value gives the same links.
CROWD = 16
#: Parts of a line of a crowd, and the characters of a rest that is not cut further; there must be so many for a part to have one at least.
PARTS, SHORT = 6, 12
#: Two words of characters, counted modulo 8, three bits each.
LETTERS = "etaonirshdlucmfpgwby ", "0123456789vkxjqz.,-:/"
TRIMMED = " \t\n\x0b\x0c\r"


def occurrences(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id, line_no, line, key`` and more columns of ``docs``, of every line that is not blank."""
    lines = docs.select(F.col(id_col).alias("id"), *more, F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(TRIMMED))).where("line <> ''")
    return lines.withColumn("key", digest(F.col("line")))


def _segment(n: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start and length of the i-th (from 1) of tau + 1 segments of a line of n characters; the last ones are the longer ones."""
    short = F.floor(n / (tau + 1)).cast("int")
    longer = n - short * (tau + 1)
    start = short * (i - 1) + F.greatest(F.lit(0), longer - (tau + 1 - (i - 1)))
    return start.cast("int"), (short + (F.lit(tau + 1 - i) < longer).cast("int")).cast("int")


def _places(lengths: DataFrame, tau: int, least: int) -> DataFrame:
    """For each length ``r`` of the given ones ``own, i, at, size``: number, start and length of the segments of a line of r characters (``own``), and of its
    substrings that may be a segment of a line of r - tau to r characters.

    All this depends on the length alone, so lines get it by a join with a small table. As expressions of each line it made methods too long for the JVM to compile.
    """
    r = F.col("r")

    def one(n: Column, i: int, shift: int, own: bool) -> Column:
        start, size = _segment(n, i, tau)
        at = start + shift
        found = F.struct(F.lit(own).alias("own"), F.lit(i).alias("i"), at.alias("at"), size.alias("size"))
        return F.when((F.lit(own) | (n >= least)) & (at >= 0) & (at + size <= r), found)

    out = [one(r, i, 0, True) for i in range(1, tau + 2)]
    for delta in range(tau + 1):
        for i in range(1, tau + 2):
            for shift in range(max(-(i - 1), delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1):
                out.append(one(r - delta, i, shift, False))
    every = lengths.select("r").distinct().select("r", F.explode(F.array(*out)).alias("p")).where("p is not null")
    return every.select("r", "p.*").distinct()


def _listed(rows: list[tuple], names: list[str]) -> Column:
    """A generator of a fixed list's rows of whole numbers; as text, since so many literals take long to make one by one."""
    return F.expr(f"inline(cast(array({','.join(f'({",".join(map(str, x))})' for x in rows)}) as array<struct<{','.join(f'{n}:int' for n in names)}>>))")


def _without_parts(tau: int, own: bool) -> tuple[list[tuple], list[str]]:
    """Every choice of tau parts of ``PARTS``, with how a line that is longer by ``delta`` moves what lies between them: ``delta, d1 .. dtau, s1 .. stau``. The line
    whose parts they are (``own``) moves nothing. Each part moves by 1 at most: of edits beyond one in a part there is a choice that has its neighbours as well."""
    found = set()
    for parts in combinations(range(PARTS), tau):
        for moves in [(0,) * tau] if own else product((-1, 0, 1), repeat=tau):
            shifts = list(accumulate(moves))
            if shifts[-1] >= 0:
                # nothing lies between neighbours, so it is not moved either
                shifts = [0 if t + 1 < tau and parts[t + 1] == parts[t] + 1 else s for t, s in enumerate(shifts)]
                found.add((shifts[-1], *parts, *shifts))
    return sorted(found), ["delta", *[f"d{t}" for t in range(1, tau + 1)], *[f"s{t}" for t in range(1, tau + 1)]]


def _joined(text: Column, spans: list[tuple[Column, Column]]) -> Column:
    return F.concat(*[F.substring(text, a + 1, b - a) for a, b in spans])


def _cut(side: DataFrame, tau: int, own: bool, *kept: str, rest: bool = False) -> DataFrame:
    """One row for each choice of parts of ``rest`` with ``kept`` and ``path``, the hash of the others and of the path so far; and, if wanted, with the ``rest`` that these parts make."""
    rows, names = _without_parts(tau, own)
    rows = side.where(F.col("r") > SHORT).select("*", _listed(rows, names)).where(F.col("r") - F.col("delta") > SHORT)
    n = F.col("r") - F.col("delta")
    short = F.floor(n / PARTS).cast("int")
    start = lambda p: short * p + F.greatest(F.lit(0), p - PARTS + n % PARTS)  # the last ones are the longer ones
    d, s = [F.col(f"d{t}") for t in range(1, tau + 1)], [F.lit(0), *[F.col(f"s{t}") for t in range(1, tau + 1)]]
    others = [(start(a) + shift, start(b) + shift) for a, b, shift in zip([F.lit(0), *[x + 1 for x in d]], [*d, F.lit(PARTS)], s, strict=True)]
    path = F.xxhash64("path", n, *d, *[F.substring("rest", a + 1, b - a) for a, b in others]).alias("path")
    left = [_joined(F.col("rest"), [(start(x) + s[t], start(x + 1) + s[t + 1]) for t, x in enumerate(d)]).alias("rest")] if rest else []
    return rows.select(*kept, path, *left)


def _without_characters(side: DataFrame, tau: int, own: bool, *kept: str) -> DataFrame:
    """One row for each way to delete tau characters (``own``: or fewer) of ``rest``, with ``kept``, ``rest`` and ``path``, the hash of what is left and of the path so far. Of equal neighbours the last ones are deleted."""
    top = SHORT if own else SHORT + tau
    names = [f"p{t}" for t in range(1, tau + 1)]
    # a place behind every end deletes nothing
    every = [(k, *places, *[10**6] * (tau - k)) for k in range(tau + 1) for places in combinations(range(top), k)]
    rows = side.where(F.col("r") <= top).select("*", _listed(every, ["k", *names]))
    p = [F.col(x) for x in names]
    for t, x in enumerate(p):
        nth = p[t + 1] == x + 1 if t + 1 < tau else F.lit(False)
        last = nth | (x + 1 >= F.col("r")) | (F.substring("rest", x + 1, F.lit(1)) != F.substring("rest", x + 2, F.lit(1)))
        rows = rows.where((F.col("k") <= t) | ((x < F.col("r")) & last))
    if not own:
        rows = rows.where(F.col("k") == F.least(F.lit(tau), F.col("r")))
    left = _joined(F.col("rest"), list(zip([F.lit(0), *[x + 1 for x in p]], [*p, F.lit(2 * 10**6)], strict=True)))
    return rows.select(*kept, "rest", F.xxhash64("path", left).alias("path"))


def letters(line: Column, n: Column) -> Column:
    """How often frequent characters occur."""
    def word(chars: str) -> Column:
        return sum((((n - F.length(F.replace(line, F.lit(c), F.lit("")))) % 8).cast("bigint") * (1 << 3 * i) for i, c in enumerate(chars)), F.lit(0).cast("bigint"))

    return F.struct(*[word(chars).alias(f"w{k}") for k, chars in enumerate(LETTERS)])


def letters_alike(a: Column, b: Column, tau: int) -> Column:
    """Whether those counts can be of lines within tau edits: an edit changes the sum of their differences by 2 at most."""
    def one(k: int, i: int) -> Column:
        d = F.abs(F.shiftright(a[f"w{k}"], 3 * i).bitwiseAND(F.lit(7)) - F.shiftright(b[f"w{k}"], 3 * i).bitwiseAND(F.lit(7)))
        return F.least(d, 8 - d)

    return reduce(Column.__and__, [sum((one(k, i) for i in range(1, len(chars))), one(k, 0)) <= 2 * tau for k, chars in enumerate(LETTERS)])


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of arrays of characters a and b is at most tau.

    The column step of the bit-vector algorithm, on a word of the band's 2 tau + 1 diagonals: bit k of a word in column j stands
    for row j - tau + k. vp and vn hold where the distance rises or falls by one from a row to the next; the score follows the lowest diagonal until it
    meets the last row, and that row from there on. a must not be shorter than b, and longer by at most tau.
    """
    # bound to a variable, so that the arrays are made once for a pair and not at each access
    return F.exists(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: _within(p["a"], p["b"], tau))


def _within(a: Column, b: Column, tau: int) -> Column:
    width = 2 * tau + 1
    full = (1 << width) - 1
    last = F.size(a) - tau  # columns in which the lowest diagonal is still above the last row

    def bit(word: Column, k: Column | int) -> Column:
        return F.getbit(word, F.lit(k) if isinstance(k, int) else k).cast("int")

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j)
        match = sum(((F.when((j >= tau - k) & (F.get(a, j - tau + k) == c), 1).otherwise(0)) * (1 << k) for k in range(width)), F.lit(0))
        vp, vn = s["vp"], s["vn"]
        sums = ((match.bitwiseAND(vp)) + vp).bitwiseAND(F.lit(full))
        d0 = sums.bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn)
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["score"].alias("score"), d0.alias("d0"))

    def after(s: Column, j: Column) -> Column:
        vp, vn, d0 = s["vp"], s["vn"], s["d0"]
        hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        k = F.greatest(F.lit(0), F.lit(width - 2) - (j - last)).cast("int")
        score = s["score"] + F.when(j < last, 1 - bit(d0, width - 1)).otherwise(bit(hp, k) - bit(hn, k))
        return F.struct(hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"), down.bitwiseAND(hp).alias("vn"), score.cast("int").alias("score"))

    first = F.struct(F.lit(full - (1 << tau) + 1).cast("int").alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("score"))
    columns = F.sequence(F.lit(0), F.size(b) - 1)
    # a lambda binds d0 once by passing it through a one-element transform
    run = F.aggregate(columns, first, lambda s, j: F.get(F.transform(F.array(step(s, j)), lambda t: after(t, j)), F.lit(0)))
    return run["score"] <= tau


def _met(lines: DataFrame, edits: int, min_chars: int, crowd: int, broadcast_rows: int = 500_000) -> DataFrame:
    """``x, y``: numbers of lines that may be within ``edits``; each pair once. Runs jobs: one to find crowds, and some more for each level of them."""
    names = ["num", "n"]

    def small(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys

    def hashed(side: DataFrame, where: DataFrame) -> DataFrame:
        """One row for each of those places, with ``path``: the hash of what is there."""
        return side.join(where, "r").select(*names, F.xxhash64("i", F.substring("line", F.col("at") + 1, F.col("size"))).alias("path"))

    def crowds(parts: DataFrame, crowd: int) -> DataFrame:
        return written(parts.groupBy("path").count().where(F.col("count") > crowd).select("path"), "line-crowds")

    def together(x: DataFrame, y: DataFrame, *more: Column) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        longer = F.col("y.n") - F.col("x.n")
        # of lines of one length each finds the other
        bound = longer.between(0, edits) & ((longer > 0) | (F.col("x.num") < F.col("y.num")))
        # merged, as the size of a written table says little of the rows made from it, by which Spark would broadcast them
        return x.join(y.hint("merge"), reduce(Column.__and__, more, (F.col("x.path") == F.col("y.path")) & bound)).select(F.col("x.num").alias("x"), F.col("y.num").alias("y"))

    lines = lines.withColumn("r", F.col("n"))
    places = written(_places(lines, edits, min_chars), "line-places")
    fits = places.count() <= broadcast_rows
    of_substrings, of_segments = [F.broadcast(places.where(c)) if fits else places.where(c) for c in ("not own", "own")]
    parts, probes = hashed(lines, of_segments), hashed(lines, of_substrings)
    heavy = crowds(parts, crowd)
    if heavy.isEmpty():
        return together(parts, probes).distinct()
    keys = small(heavy)
    met = [written(together(parts.join(keys, "path", "left_anti"), probes), "line-met")]
    # the lines that have a crowded segment, and those of lengths that may find one
    owners = parts.join(keys, "path").select("num", "n")
    lengths = owners.select(F.explode(F.sequence(F.col("n"), F.col("n") + edits)).alias("n")).distinct()  # one row for each length at most
    finders = hashed(lines.join(F.broadcast(lengths), "n"), of_substrings).join(keys, "path").select("num")
    few = written(owners.select("num").union(finders).distinct(), "line-crowded")
    bag = letters(F.col("line"), F.col("n")).alias("bag")
    # each side's lines, by the parts taken out so far (at first none), and what is left of them
    owners = finders = written(lines.join(small(few), "num").select(*names, bag, F.lit(0).cast("long").alias("path"), F.col("line").alias("rest"), "r"), "line-crowded")
    names.append("bag")
    alike = letters_alike(F.col("x.bag"), F.col("y.bag"), edits)
    near = F.levenshtein("x.rest", "y.rest", edits) >= 0
    while True:
        ends = together(_without_characters(owners, edits, True, *names), _without_characters(finders, edits, False, *names), near)
        parts, probes = _cut(owners, edits, True, *names), _cut(finders, edits, False, *names)
        heavy = crowds(parts, 4 * crowd)
        keys = small(heavy)
        met.append(written(ends.union(together(parts.join(keys, "path", "left_anti"), probes, alike)), "line-met"))
        if heavy.isEmpty():
            return reduce(DataFrame.union, met).distinct()
        owners, finders = [written(_cut(side, edits, own, *names, rest=True).join(keys, "path").distinct().withColumn("r", F.length("rest")), "line-crowded")
                           for side, own in ((owners, True), (finders, False))]


def links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_rows: int = 500_000, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` of keys of different lines within ``edits``; ``lines`` has ``num, key, line`` of each line once."""
    if min_chars < 2 * (edits + 1) + edits:
        raise ValueError("lines must be longer than twice the number of segments and edits")
    lines = lines.withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    pairs = written(_met(lines, edits, min_chars, crowd, broadcast_rows), "line-pairs")
    wanted = pairs.select(F.col("x").alias("num")).union(pairs.select("y")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = written(lines.join(wanted, "num").select("num", "key", "line", letters(F.col("line"), F.col("n")).alias("bag")), "line-texts")
    side = lambda num, key, line, bag: texts.select(F.col("num").alias(num), F.col("key").alias(key), F.col("line").alias(line), F.col("bag").alias(bag))
    both = pairs.join(side("x", "a", "shorter", "x_bag"), "x").join(side("y", "b", "long", "y_bag"), "y").where(letters_alike(F.col("x_bag"), F.col("y_bag"), edits))
    chars = both.select("a", "b", F.split("long", "").alias("long"), F.split("shorter", "").alias("shorter"))
    return chars.where(within(F.col("long"), F.col("shorter"), edits)).select("a", "b")


def classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """One row per line that is not blank: ``id, line_no, class_id, class_line_no`` (where its class first occurs), ``class_size`` (occurrences),
    ``n_links`` (different lines linked with it), ``kept``. With ``by_row`` also ``row``, a key of id and text, and of rows that share an id only one keeps the line."""
    row = ["row"] if by_row else []
    found = occurrences(docs, id_col, text_col, *([row_key(id_col, text_col).alias("row")] if by_row else []))
    # numbered in the written table, so that a number never changes
    lines = found.groupBy("key", "line").agg(F.count("*").alias("times")).withColumn("num", F.monotonically_increasing_id())
    lines = written(lines, "line-texts")
    pairs = written(links(lines.select("num", "key", "line"), edits, min_chars), "line-links")
    roots = components(pairs, "line-classes").withColumnRenamed("id", "key")
    degree = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).groupBy("key").agg(F.count("*").alias("n_links"))
    linked = degree.join(roots, "key", "left")
    # lines that occur once and are linked with none are their own class
    shared = lines.select("key", "times").join(linked, "key", "left").where("times > 1 or n_links > 0") \
        .select("key", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = found.select("id", "line_no", *row, "key").join(shared, "key", "left").drop("key")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "line_no", *row)
    named = written(named, "line-named")
    whole = named.where("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    rows = named.join(written(whole, "line-whole"), "root", "left")  # written, so that a class with many lines can be split in the join
    alone = F.col("first").isNull()
    same = alone | (F.col("row") == F.col("first.row")) if by_row else F.lit(True)
    return rows.select("id", "line_no", *row, same.alias("same"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
                       F.when(alone, F.col("line_no")).otherwise(F.col("first.line_no")).alias("class_line_no"),
                       F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")) \
        .withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")) & (F.col("line_no") == F.col("class_line_no")) & F.col("same")).drop("same")


def drop_duplicate_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that do not stay; all columns stay, null texts stay null. Rows are told apart by id and text."""
    row, gone = free_names(docs, "row", "gone")
    lost = classes(docs, edits, min_chars, id_col, text_col, by_row=True).where("not kept").groupBy(F.col("row").alias(row)) \
        .agg(F.collect_set("line_no").alias(gone))  # at most one entry for each line of a document
    rows = docs.withColumn(row, row_key(id_col, text_col)).join(lost, row, "left")
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest)).select(*docs.columns)
