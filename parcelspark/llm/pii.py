"""Personal data: rules, and boosted trees over candidate spans, DataFrame functions only.

Rules find e-mail addresses, IPv4 addresses, card and phone numbers, leftmost and non-overlapping per kind, and drop matches that fail a
check (parts up to 255, Luhn, numbers of digits). Beside them high-recall generators propose overlapping candidates of the same kinds and of secrets:
addresses with spelt-out or bracketed signs, runs of digits in any grouping (each both as a card and as a phone), long tokens. A candidate has format
features (digits, groups, separators, checks) and context features (characters around it, cue words before it), and gradient-boosted trees score it.

What the trees learn goes beyond the rules. All documents give places in their texts (with ``max_docs`` a part of them, chosen by hash). There
``FORMS`` puts invented values: the rules' formats, obfuscated and regrouped forms of them that the rules do not know, keys and tokens; and as negatives numbers, versions, dates, checksums
and words of like shapes. Cue words stand before some of either. What the documents hold by themselves is added: candidates on the rules' finds are positives; others are
negatives, but those behind a cue word are left out, since nobody knows what they are. The features that repeat a rule's own check are hidden at random in training, so that trees do not
lean on them alone. One tenth of the documents calibrates a threshold for each kind: the lowest score at or above which ``precision`` of the candidates are
positive. Another tenth measures recall and precision (``Model.report``). Candidates above it that overlap nothing found by the rules are added; of several
that overlap in a chain, the best.

Everything but the fit works within rows: no row is shuffled. Positions come from splitting a text by the pattern and summing lengths in blocks, overlaps from sorting
and running maxima, so time grows about linearly with the matches of a text; possessive quantifiers and anchors at runs keep matching linear in long runs.

Defined results: null is empty; empty texts have no spans; an empty table to fit on gives a model that adds nothing. Repeated rows each
get their spans; null ids stay null; an empty table gives an empty result; further columns are ignored by ``spans`` and kept by ``redacted``.
Fitting runs jobs; it writes its candidates to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

#: Those with rules come first.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The rules' patterns, with possessive quantifiers; a run's matches start at its beginning or where the last match ended.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a rule to be tried at all.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
_AT, _DOT = r" ?(?:@|[(\[{<]at[)\]}>]) ?", r" ?(?:\.|[(\[{<]dot[)\]}>]) ?"
#: Pattern, what a text must contain, and the kinds that each match is proposed as.
GENERATORS = (
    (rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++| at [a-z0-9-]++(?: dot [a-z0-9-]++)++)", r"(?i)@|[(\[{<]at[)\]}>]| at [a-z0-9-]+ dot ", ("email",)),
    (r"(?i)(?<![0-9a-z.])[0-9]{1,4}+(?:(?:\.|[(\[{]\.[)\]}]| ?[(\[{]dot[)\]}] ?| dot )[0-9]{1,4}+){3,5}+", r"[0-9](?:[)\]}(\[{ ]*(?:\.|dot)[)\]}(\[{ ]*[0-9]+){2}", ("ip",)),
    (r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().:/-]{0,3}+[0-9])++", r"[0-9](?:[ ().:/-]{0,3}[0-9]){6}", ("card", "phone")),
    (r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_/+=.-]{16,}+", r"[A-Za-z0-9_/+=.-]{16}", ("secret",)),
)
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = {"email": ("mail", "contact", "write to"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "credit"), "phone": ("phone", "tel", "call"), "secret": ("token", "api_key", "password", "secret")}
AROUND, BLOCK = 24, 128
#: Places of the features that repeat a rule's check.
CHECKS = (7, 8, 13, 14)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, whatever number of times the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(df: DataFrame, names: list[str], value: Callable, plus: Callable, zero: Column) -> DataFrame:
    """Each array column of ``names`` becomes an array of struct(x, run): each item with the combination by ``plus``, which is associative, of the values before it.

    Blocks of items are combined on their own and then brought together, so that no long array is copied for each item.
    """
    def block(v: Column, k: Column) -> Column:
        none = F.slice(F.transform(F.slice(v, 1, 1), lambda x: F.struct(x.alias("x"), zero.alias("run"))), 1, 0)
        return F.aggregate(F.slice(v, k + 1, F.lit(BLOCK)), F.struct(zero.alias("run"), none.alias("out")), lambda s, x: F.struct(
            plus(s["run"], value(x)).alias("run"), F.concat(s["out"], F.array(F.struct(x.alias("x"), s["run"].alias("run")))).alias("out")))

    def before(blocks: Column) -> Column:
        start = F.struct(zero.alias("run"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(blocks, start, lambda s, b: F.struct(plus(s["run"], b["run"]).alias("run"), F.concat(s["out"], F.array(s["run"])).alias("out")), lambda s: s["out"])

    def together(v: Column) -> Column:
        return F.flatten(F.transform(v["b"], lambda b, k: F.transform(b["out"], lambda y: F.struct(y["x"].alias("x"), plus(F.get(v["p"], k), y["run"]).alias("run")))))

    # stages of their own, since functions within functions take long to resolve
    df = df.withColumns({n: bound(F.col(n), lambda v: F.transform(F.sequence(F.lit(0), F.size(v), F.lit(BLOCK)), lambda k: block(v, k))) for n in names})
    df = df.withColumns({f"{n}_p": bound(F.col(n), before) for n in names})
    return df.withColumns({n: bound(F.struct(F.col(n).alias("b"), F.col(f"{n}_p").alias("p")), together) for n in names}).drop(*[f"{n}_p" for n in names])


MATCHES = "array<struct<found:string,gap:int,before:string,after:string>>"


def matched(df: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """For each named (pattern, what a text must contain) an array of struct(start, found, before, after) of its matches in ``text``: match i follows
    piece i of the text split by the pattern."""
    text = F.col("text")
    df = df.withColumns({n: F.when(text.rlike(needs), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern).alias("p"))) for n, (pattern, needs) in patterns.items()})
    items = lambda s: F.transform(s["f"], lambda f, i: F.struct(f.alias("found"), F.length(F.get(s["p"], i)).alias("gap"), F.right(F.get(s["p"], i), F.lit(AROUND)).alias("before"),
                                                                F.left(F.get(s["p"], i + 1), F.lit(1)).alias("after")))
    df = df.withColumns({n: F.coalesce(bound(F.col(n), items), F.array().cast(MATCHES)) for n in patterns})
    df = running(df, list(patterns), lambda x: x["gap"] + F.length(x["found"]), lambda a, b: a + b, F.lit(0))
    return df.withColumns({n: F.transform(n, lambda y: F.struct((y["run"] + y["x"]["gap"]).alias("start"), y["x"]["found"].alias("found"), y["x"]["before"].alias("before"), y["x"]["after"].alias("after"))) for n in patterns})


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return (F.length(digits) > 0) & (F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0)


def _valid(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        return found.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(found))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def with_base(df: DataFrame) -> DataFrame:
    """``df`` with ``base``: what the rules find in ``text``, an array of struct(start, kind, end) in order."""
    def of(k: int, kind: str) -> Column:
        good = F.filter(f"rule_{kind}", lambda m: _valid(kind, m["found"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["found"])).alias("end")))

    df = matched(df, {f"rule_{kind}": (pattern, NEEDS[kind]) for kind, pattern in RULES.items()})
    return df.withColumn("base", F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(RULES)]))).drop(*[f"rule_{kind}" for kind in RULES])


def _cue(kind: str, before: Column) -> Column:
    return F.lower(before).rlike(rf"(?:{'|'.join(CUES[kind])})[^a-z]*$")


def _features(kind: str, m: Column) -> Column:
    found, before, digits = m["found"], m["before"], _digits(m["found"])
    count = lambda chars: F.length(found) - F.length(F.translate(found, chars, ""))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [
        F.lit(float(KINDS.index(kind))), F.length(digits), F.length(found), count("."), count(" "), count("-"), count("()[]{}<>"), yes(found.startswith("+")), yes(found.contains("@")),
        yes(before.rlike(r"[\p{L}0-9]$")), yes(m["after"].rlike(r"[\p{L}0-9]")), yes(_cue(kind, before)), F.length(F.regexp_replace(found, "[^A-Za-z]", "")),
        yes(F.when(F.length(digits).between(12, 20), luhn(digits)).otherwise(False)), yes(found.rlike(rf"(?i)^(?:{PART}[^0-9]+){{3}}{PART}$")),
        yes(before.rlike(r"[=\"':]\s*$")), yes(before.rlike(r"(?:^|\s)$")), yes(F.lower(found).rlike(r"[^a-z](?:at|dot)[^a-z]")), F.regexp_count(found, F.lit(r"[0-9]++")), F.regexp_count(found, F.lit("[A-Z]")),
        yes(found.rlike(r"(?:^|[^0-9])[0-9]{3}[^0-9]{1,3}[0-9]{3}[^0-9]{1,3}[0-9]{4}$")), yes(found.rlike(r"^(?:[0-9]{4}[^0-9]{1,3}){3}[0-9]{4}$")), yes(found.rlike("^[0-9a-f]+$")),
        F.regexp_count(found, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")), F.length(F.regexp_extract(found, "([A-Za-z]*)$", 1)), count("/:"), count("_=+"),
        F.size(F.array_distinct(F.split(F.left(found, F.lit(64)), ""))),
    ]
    return F.array(*[v.cast("double") for v in values])


CANDIDATES = "array<struct<start:int,end:int,c:struct<start:int,kind:int,end:int,cue:boolean,features:array<double>>>>"


def with_candidates(df: DataFrame) -> DataFrame:
    """``df`` with ``found``: overlapping candidate spans of ``text``, struct(start, kind, end, cue, features)."""
    def of(found: Column, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["found"])).alias("end"),
                                                     _cue(kind, m["before"]).alias("cue"), _features(kind, m).alias("features")))

    def proposed(name: str, kinds: tuple[str, ...]) -> Column:
        digits = {"email": 0, "ip": 4, "card": 7, "secret": 4}[kinds[0]]
        found = F.filter(name, lambda m: F.length(_digits(m["found"])) >= digits)
        return bound(found, lambda v: F.concat(*[of(v, kind) for kind in kinds]))

    df = matched(df, {f"maybe_{k}": (pattern, needs) for k, (pattern, needs, _) in enumerate(GENERATORS)})
    return df.withColumn("found", F.concat(*[proposed(f"maybe_{k}", kinds) for k, (_, _, kinds) in enumerate(GENERATORS)])).drop(*[f"maybe_{k}" for k in range(len(GENERATORS))])


def free(df: DataFrame) -> DataFrame:
    """``found`` becomes the candidates that overlap no span of ``base``, in order."""
    far = F.lit(2**31 - 1)
    item = lambda x, c: F.struct(x["start"].alias("start"), x["end"].alias("end"), c.alias("c"))

    def every(v: Column) -> Column:
        none = F.when(F.lit(False), F.get(v["found"], F.lit(0)))
        return F.array_sort(F.concat(F.transform(v["base"], lambda b: item(b, none)), F.transform(v["found"], lambda c: item(c, c))))

    df = df.withColumn("found", F.when(F.size("found") > 0, bound(F.struct("found", "base"), every)).otherwise(F.array().cast(CANDIDATES)))
    df = running(df, ["found"], lambda x: F.when(x["c"].isNull(), x["end"]).otherwise(0), F.greatest, F.lit(0))
    df = df.withColumn("found", F.reverse(F.transform(F.filter("found", lambda y: y["x"]["c"].isNull() | (y["x"]["start"] >= y["run"])), lambda y: y["x"])))
    df = running(df, ["found"], lambda x: F.when(x["c"].isNull(), x["start"]).otherwise(far), F.least, far)
    return df.withColumn("found", F.reverse(F.transform(F.filter("found", lambda y: y["x"]["c"].isNotNull() & (y["x"]["end"] <= y["run"])), lambda y: y["x"]["c"])))


def chained(df: DataFrame, name: str) -> DataFrame:
    """An array of spans ordered by start becomes one of struct(x, group): spans that overlap, directly or through others, are one group."""
    df = running(df, [name], lambda x: x["end"], F.greatest, F.lit(0))
    df = df.withColumn(name, F.transform(name, lambda y: F.struct(y["x"].alias("x"), F.when(y["x"]["start"] >= y["run"], 1).otherwise(0).alias("new"))))
    df = running(df, [name], lambda x: x["new"], lambda a, b: a + b, F.lit(0))
    return df.withColumn(name, F.transform(name, lambda y: F.struct(y["x"]["x"].alias("x"), (y["run"] + y["x"]["new"]).alias("group"))))


def _tree(node, features: Column) -> Column:
    """A fitted tree as an expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(features, F.lit(split.featureIndex())) <= split.threshold(), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


class Model:
    """Boosted trees, the threshold of each kind, and what was measured: ``report[kind]`` is (positives, of them found, all found). No trees add nothing."""

    def __init__(self, trees: list, thresholds: dict[int, float], report: dict | None = None):
        self.trees, self.thresholds, self.report = trees, thresholds, report or {}

    def score(self, features: Column) -> Column:
        """The margin: twice that is the log-odds."""
        return sum((_tree(node, features) * weight for node, weight in self.trees), F.lit(0.0))

    def passes(self, kind: Column, score: Column) -> Column:
        return F.coalesce(*[F.when(kind == k, score >= t) for k, t in self.thresholds.items()], F.lit(False))


def _drawn(places: DataFrame) -> DataFrame:
    """``places`` with what invented values are made of: ``hexes``, ``mixed`` (letters and digits), ``body`` and ``check`` (15 digits and the one that makes them pass Luhn)."""
    rows = places.withColumn("hexes", F.concat(*[F.md5(F.concat(F.col("key").cast("string"), F.lit(str(k)))) for k in range(3)])).withColumn("body", _number(21, 15))
    name = lambda at, n: F.translate(F.substring("hexes", at, n), "0123456789", "ghijklmnop")
    mixed = F.concat(*[F.when(F.substring("hexes", k + 1, 1) < "8", F.upper(name(k + 3, 3))).otherwise(F.concat(name(k + 7, 1), F.substring("body", k // 5 + 1, 2))) for k in range(0, 60, 5)])
    tenth = F.element_at(F.filter(F.array(*map(F.lit, "0123456789")), lambda d: luhn(F.concat("body", d))), 1)
    return rows.withColumns({"mixed": F.rpad(mixed, 48, "7aQ"), "check": tenth})


def _number(seed: int, n: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(10**n)).cast("string"), n, "0")


def _invented() -> list[tuple[str, int, Column]]:
    """``FORMS``: (kind, 1 or 0, value) made from what was drawn."""
    digits, hexes, mixed, body, right = _number, F.col("hexes"), F.col("mixed"), F.col("body"), F.col("check")
    draw = lambda seed: F.xxhash64(F.lit(seed), "key")
    part = lambda seed: F.pmod(draw(seed), F.lit(256)).cast("string")
    name = lambda at, n: F.translate(F.substring(hexes, at, n), "0123456789", "ghijklmnop")
    c = F.concat
    join = lambda parts, sep: F.concat_ws(sep, *parts)
    user, host, top = c(name(1, 5), digits(1, 2)), c(name(9, 6)), F.element_at(F.array(*map(F.lit, ("com", "org", "net", "example"))), (F.pmod(draw(2), F.lit(4)) + 1).cast("int"))
    ip = [part(k) for k in (11, 12, 13, 14)]
    card, fault = c(body, right), c(body, F.pmod(right.cast("int") + 1 + F.pmod(draw(22), F.lit(8)).cast("int"), F.lit(10)).cast("string"))
    fours = lambda x: [F.substring(x, k, 4) for k in (1, 5, 9, 13)]
    phone = [digits(31, 3), digits(32, 3), digits(33, 4)]
    year = c(F.lit("20"), digits(41, 2))
    good = {
        "email": [c(user, F.lit("@"), host, F.lit("."), top), c(user, F.lit(" (at) "), host, F.lit(" (dot) "), top), c(user, F.lit(" [at] "), host, F.lit(" [dot] "), top), c(user, F.lit(" at "), host, F.lit(" dot "), top),
                  c(user, F.lit("{at}"), host, F.lit("{dot}"), top), c(user, F.lit(" @ "), host, F.lit(" . "), top), c(user, F.lit(" (at) "), host, F.lit("."), top)],
        "ip": [join(ip, "."), join(ip, "[.]"), join(ip, "(.)"), join(ip, " dot "), join(ip, "[dot]"), join(ip, " (dot) ")],
        "card": [card, join(fours(card), " "), join(fours(card), "."), join(fours(card), "/"), join(fours(card), "  "), join(fours(card), " - ")],
        "phone": [c(F.lit("+1 ("), phone[0], F.lit(") "), phone[1], F.lit("-"), phone[2]), join(phone, " "), join(phone, "-"), join(phone, "."), c(F.lit("("), phone[0], F.lit(") "), phone[1], F.lit("-"), phone[2]),
                  c(F.lit("001 "), join(phone, " ")), join(phone, " / ")],
        "secret": [F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substring(mixed, 1, 44), c(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)), c(F.lit("ghp_"), F.substring(mixed, 1, 36)), c(F.lit("sk-"), F.substring(mixed, 1, 32))],
    }
    bad = {
        "email": [c(name(1, 4), F.lit(" @ "), digits(51, 1), F.lit(" . "), digits(52, 2)), c(name(1, 4), F.lit(" at "), name(9, 4), F.lit(" dot matrix"))],
        "ip": [join([digits(61, 1), *ip], "."), join([c(F.lit("3"), digits(62, 2)), *ip[1:]], "."), join([digits(k, 1) for k in range(63, 68)], "."), join([c(F.lit("9"), digits(68, 2)), *ip[1:]], "[.]")],
        "card": [fault, join(fours(fault), " "), digits(71, 12), c(digits(72, 16), digits(73, 6)), join(fours(fault), ".")],
        "phone": [digits(81, 10), digits(82, 7), join([year, digits(83, 2), digits(84, 2), digits(85, 4)], "-"), c(F.lit("978-3-"), digits(86, 2), F.lit("-"), digits(87, 6), F.lit("-0")), join([year, year, year], " "),
                  c(year, F.lit("-03-"), digits(88, 2), F.lit(" 12:"), digits(89, 2), F.lit(":30")), join([digits(90, 1), digits(91, 1), digits(92, 2), digits(93, 3)], " ")],
        "secret": [F.substring(hexes, 1, 40), c(name(1, 6), F.lit("-"), name(9, 5), F.lit("-"), name(17, 7), F.lit("-"), year), c(F.lit("www."), host, F.lit(".com/"), year, F.lit("/"), name(3, 6)), c(F.repeat(F.lit("="), 18), year),
                   c(F.repeat(name(1, 1), 20), year), c(name(1, 8), F.lit("_"), name(9, 8), F.lit("_"), year)],
    }
    return [(kind, 1, v) for kind, vs in good.items() for v in vs] + [(kind, 0, v) for kind, vs in bad.items() for v in vs]


def examples(docs: DataFrame, max_docs: int | None, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``tenth`` (of the documents), ``own`` (found in a document as it stands), ``label``, ``kind``, ``features``: candidates to learn and to measure on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text).alias("draw"), text.alias("text"))
    if max_docs is not None and (total := docs.count()) > max_docs:
        some = some.where(F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * (max_docs / total)))
    some = some.withColumn("tenth", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(10)).cast("int"))
    # written first: a filter on candidates would otherwise be pushed below all the steps that make them
    own = with_candidates(with_base(some.select("tenth", "text"))).drop("text").withColumn("every", F.col("found"))
    own = written(free(own), "pii-own")
    hit = own.select("tenth", "base", F.explode("every").alias("c"))
    hit = hit.where(F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))).select("tenth", F.lit(1).alias("label"), "c")
    rest = own.select("tenth", F.lit(0).alias("label"), F.explode(F.filter("found", lambda c: ~c["cue"])).alias("c"))
    own = rest.union(hit).select("tenth", F.lit(True).alias("own"), "label", "c.kind", "c.features")
    # values at places of the texts: four for each document
    places = some.select("tenth", "text", "draw", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("nth"))
    places = places.withColumn("key", F.xxhash64("draw", "nth")).withColumn("at", F.pmod("key", F.greatest(F.length("text"), F.lit(1))).cast("int"))
    places, forms = _drawn(places), _invented()
    pick = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(len(forms))).cast("int")
    chance = lambda k: F.conv(F.substring(F.md5(F.concat("hexes", F.lit(str(k)))), 1, 4), 16, 10).cast("int") / 65536
    cue = F.element_at(F.array(*[F.element_at(F.array(*map(F.lit, CUES[kind])), (F.pmod(F.xxhash64(F.lit(6), "key"), F.lit(len(CUES[kind]))) + 1).cast("int")) for kind, _, _ in forms]), pick + 1)
    # a token without a cue is a checksum as likely as a key; others need none
    often = F.element_at(F.array(*[F.lit(1.0 if kind == "secret" and label else 0.0 if kind == "secret" else 0.5 if label else 0.1) for kind, label, _ in forms]), pick + 1)
    sign = F.element_at(F.array(*map(F.lit, (": ", " = \"", " ", "=", ": \""))), (F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(5)) + 1).cast("int"))
    value = F.element_at(F.array(*[v for _, _, v in forms]), pick + 1)
    made = places.select("tenth", value.alias("value"), F.element_at(F.array(*[F.lit(KINDS.index(kind)) for kind, _, _ in forms]), pick + 1).alias("kind"), F.element_at(F.array(*[F.lit(label) for _, label, _ in forms]), pick + 1).alias("good"),
                         F.concat(F.substring("text", F.greatest(F.lit(1), F.col("at") - 30), 30), F.lit(" "), F.when(chance(1) < often, F.concat(cue, sign)).otherwise("")).alias("head"),
                         F.concat(F.element_at(F.array(*map(F.lit, (" ", "\n", ". ", "\" ", ", "))), (F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(5)) + 1).cast("int")), F.substring("text", F.col("at") + 1, 20)).alias("tail"))
    start = F.length("head")
    made = made.select("tenth", "kind", "good", start.alias("start"), (start + F.length("value")).alias("end"), F.concat("head", "value", "tail").alias("text"))
    made = written(with_candidates(made).drop("text"), "pii-made").select("tenth", "kind", "good", "start", "end", F.explode("found").alias("c"))
    shared = F.least("end", "c.end") - F.greatest("start", "c.start")
    covers = shared >= 0.8 * (F.greatest("end", "c.end") - F.least("start", "c.start"))
    made = made.where(covers).select("tenth", F.lit(False).alias("own"), F.when(F.col("kind") == F.col("c.kind"), F.col("good")).otherwise(0).alias("label"), "c.kind", "c.features")
    return own.union(made)


def fit(docs: DataFrame, max_docs: int | None = None, trees: int = 16, depth: int = 4, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Model:
    """Fit, calibrate and measure on examples from all documents, or from about ``max_docs`` of them, chosen by hash of id and text.

    Examples with equal features and labels are one row that weighs as many, so what is learnt from grows with the kinds of examples and not with their number.
    """
    rows = examples(docs, max_docs, id_col, text_col, seed).groupBy("tenth", "own", "label", "kind", "features").agg(F.count("*").alias("n"))
    rows = written(rows, "pii-examples")
    hidden = F.transform("features", lambda v, i: F.when(i.isin(*CHECKS) & (F.pmod(F.xxhash64(F.lit(seed), "features", i), F.lit(10)) < 3), 0.0).otherwise(v))
    learn = rows.where("tenth > 1").select(F.col("label").cast("double").alias("label"), F.col("n").cast("double").alias("weight"), array_to_vector(F.when(F.col("own"), F.col("features")).otherwise(hidden)).alias("features"))
    if learn.select("label").distinct().count() < 2:
        return Model([], {})
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, subsamplingRate=1.0, weightCol="weight").fit(learn)
    jvm = [model._java_obj.trees()[i] for i in range(model.getNumTrees)]
    fitted = Model([(t.rootNode(), w) for t, w in zip(jvm, model.treeWeights)], {})
    scored = rows.where("tenth <= 1").select("tenth", "kind", "label", "n", F.round(fitted.score(F.col("features")), 3).alias("score"))
    # distinct rounded scores of a few small trees
    table = scored.groupBy("tenth", "kind", "score").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).orderBy(F.col("score").desc()).collect()
    for kind in range(len(KINDS)):
        good = n = 0
        for r in (r for r in table if r["tenth"] == 0 and r["kind"] == kind):
            good, n = good + r["good"], n + r["n"]
            if good >= precision * n:
                fitted.thresholds[kind] = float(r["score"])
        seen = [r for r in table if r["tenth"] == 1 and r["kind"] == kind]
        above = [r for r in seen if r["score"] >= fitted.thresholds.get(kind, float("inf"))]
        fitted.report[KINDS[kind]] = (sum(r["good"] for r in seen), sum(r["good"] for r in above), sum(r["n"] for r in above))
    return fitted


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``base`` and ``added``, arrays of struct(start, kind, end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = with_base(docs.select(F.col(id_col).alias("id"), text.alias("text")))
    if not model.thresholds:
        return rows.select("id", "base", F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("added"))
    rows = free(with_candidates(rows)).drop("text")
    rows = rows.withColumn("found", F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), model.score(c["features"]).alias("score"))))
    rows = chained(rows.withColumn("found", F.filter("found", lambda c: model.passes(c["kind"], c["score"]))), "found")
    ranked = F.array_sort(F.transform("found", lambda y: F.struct(y["group"].alias("group"), (-y["x"]["score"]).alias("worse"), y["x"]["start"].alias("start"), y["x"]["kind"].alias("kind"), y["x"]["end"].alias("end"))))
    best = bound(ranked, lambda v: F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1)["group"] != x["group"])))
    return rows.select("id", "base", F.transform(best, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("added"))


def named(found: Column) -> Column:
    """kind:start:end, comma-joined, of an ordered array of spans."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def redacted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one, named by the first. Null texts stay null."""
    row, whole = free_names(docs, "row", "whole")
    found = spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text_col).cast("string").alias(whole)), model, row, whole)
    text, kinds, far = F.col("id")[text_col], F.array(*map(F.lit, KINDS)), F.lit(2**31 - 1)
    found = found.select("id", F.array_sort(F.concat("base", "added", F.array(F.struct(far.alias("start"), F.lit(0).alias("kind"), far.alias("end"))))).alias("every"))
    found = running(found, ["every"], lambda x: x["end"], F.greatest, F.lit(0))
    # the greatest end before the next chain is this chain's end
    heads = F.filter("every", lambda y: y["x"]["start"] >= y["run"])
    chains = bound(heads, lambda v: F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda y, i: F.struct(y["x"]["start"].alias("start"), y["x"]["kind"].alias("kind"), F.get(v, i + 1)["run"].alias("end"))))
    found = found.select("id", chains.alias("chains"))

    def block(v: Column, k: Column) -> Column:
        first, last = F.get(v["c"], k)["start"], F.coalesce(F.get(v["c"], k + BLOCK)["start"], F.length(v["t"]))
        return F.struct(F.slice(v["c"], k + 1, F.lit(BLOCK)).alias("s"), F.substring(v["t"], first + 1, last - first).alias("t"), first.alias("o"), last.alias("e"))

    def cut(h: Column) -> Column:
        return F.array_join(F.transform(h["s"], lambda x, i: F.concat(F.lit("["), F.get(kinds, x["kind"]), F.lit("]"), F.substring(
            h["t"], x["end"] - h["o"] + 1, F.coalesce(F.get(h["s"], i + 1)["start"], h["e"]) - x["end"]))), "")

    # pieces come from blocks of the text, so that a long text is not read from its start for each
    some = F.size("chains") > 0
    blocks = bound(F.struct(F.col("chains").alias("c"), text.alias("t")), lambda v: F.transform(F.sequence(F.lit(0), F.size(v["c"]) - 1, F.lit(BLOCK)), lambda k: block(v, k)))
    found = found.select("id", "chains", F.when(some, blocks).alias("blocks"))
    clean = F.when(some, F.concat(F.substring(text, F.lit(1), F.get("chains", F.lit(0))["start"]), F.array_join(F.transform("blocks", cut), ""))).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns])
