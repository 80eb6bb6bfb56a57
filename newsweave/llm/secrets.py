"""Secret scans with Spark functions only: patterns, and a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.session import cut_lineage

# The patterns of the contract, with least lengths where a run of
# the class is taken whole, so that a shorter one cannot match further on.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
# What the randomness tests look at, and the alphabets an encoding is inferred
# from, smallest first.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
)
FALSE_DISCOVERIES = 0.05
# Bins of a tenfold change in p.
_BINS = 20


def _once(fields: dict[str, Column], build) -> Column:
    """``build`` of a struct of ``fields``, each of which is computed a single time
    however often it is used; an outer expression inside a lambda would be computed
    again for every element."""
    held = F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.element_at(F.transform(held, build), 1)


def _running(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values."""
    return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """Where each of pieces laid end to end starts. Sums run in blocks of the
    square root of their number, as a sum that grows an array copies it each time."""
    count = F.size(lengths)
    block = F.ceil(F.sqrt(count.cast("double"))).cast("int")

    def cut(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s["lengths"]) - 1) / s["block"]).cast("int")),
                           lambda b: F.slice(s["lengths"], b * s["block"] + 1, s["block"]))

    def joined(s: Column) -> Column:
        inner = F.transform(s["blocks"], lambda b: F.slice(_running(b), F.lit(1), F.size(b)))
        before = F.slice(_running(F.transform(s["blocks"], _total)), F.lit(1), F.size(s["blocks"]))
        return F.flatten(F.zip_with(inner, before, lambda own, first: F.transform(own, lambda x: x + first)))

    return _once({"lengths": lengths, "block": block}, lambda s: _once({"blocks": cut(s)}, joined))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, match, value: group 2 if the pattern has one), in code
    points, end exclusive: leftmost matches that do not overlap. What stands between
    matches and the matches themselves take turns, and their lengths add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found

    def placed(s: Column) -> Column:
        # The piece before each match and the match itself, as one length each.
        gaps = F.transform(F.slice(s["between"], F.lit(1), F.size(s["found"])), F.length)
        return _once({"gaps": gaps, "steps": F.zip_with(gaps, s["found"], lambda gap, own: gap + F.length(own))}, lambda t: F.transform(
            F.arrays_zip(_starts(t["steps"]).alias("before"), t["gaps"].alias("gap"), s["found"].alias("match"), s["inner"].alias("value")),
            lambda r: F.struct((r["before"] + r["gap"]).alias("start"), (r["before"] + r["gap"] + F.length(r["match"])).alias("end"),
                               r["match"].alias("match"), r["value"].alias("value"))))

    rows = _once({"found": found, "inner": inner, "between": F.split(text, pattern, -1)}, placed)
    return F.when(text.rlike(pattern), rows).otherwise(F.lit(None))


def _spans(kind: int, rows: Column) -> Column:
    made = F.transform(rows, lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), r["end"].alias("end")))
    return F.coalesce(made, F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the contract's three kinds."""
    assigned = F.filter(matches(text, ASSIGN), lambda r: F.length(r["value"]) >= 12)
    return {"assign": _spans(0, assigned), "access": _spans(1, matches(text, ACCESS)), "hex": _spans(2, matches(text, HEX))}


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by its logistic approximation."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _alphabet(token: Column) -> Column:
    found = F.lit(None).cast("string")
    for alphabet in reversed(ALPHABETS):
        inside = alphabet.replace("-", "\\-")
        found = F.when(token.rlike(f"^[{inside}]+$"), F.lit(alphabet)).otherwise(found)
    return found


def _tests(token: Column) -> Column:
    """(n, p) of a token without padding: three tests of the hypothesis that its
    letters are drawn evenly and independently from the inferred alphabet. p is
    three times the least of their p-values, 1 at most; null without an alphabet."""
    def counted(s: Column) -> dict[str, Column]:
        places = s["places"]
        pairs = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        add = lambda rows, value: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + value(x))
        kinds = F.transform(F.sequence(F.lit(1), F.length(s["alphabet"])), lambda a: F.size(F.filter(places, lambda x: x == a)))
        return {
            "n": F.size(places).cast("double"), "size": F.length(s["alphabet"]).cast("double"),
            "squares": add(kinds, lambda c: c.cast("long") * c).cast("double"),
            "high": F.size(F.filter(places, lambda x: x * 2 > F.length(s["alphabet"]))).cast("double"),
            "runs": 1 + add(pairs, lambda p: ((p["a"] * 2 > F.length(s["alphabet"])) != (p["b"] * 2 > F.length(s["alphabet"]))).cast("long")),
            "total": add(places, lambda x: x.cast("long")).cast("double"),
            "powers": add(places, lambda x: x.cast("long") * x).cast("double"),
            "products": add(pairs, lambda p: p["a"].cast("long") * p["b"]).cast("double"),
            "ends": F.element_at(places, 1).cast("double") + F.element_at(places, -1),
        }

    def measured(c: Column) -> Column:
        n, size, high, low = c["n"], c["size"], c["high"], c["n"] - c["high"]
        uneven = (size / n * c["squares"] - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        run_p = F.when(spread > 0, 2 * _tail(F.abs((c["runs"] - 1 - 2 * high * low / n) / F.sqrt(spread)))).otherwise(0.0)
        mean = c["total"] / n
        squared = c["powers"] - n * mean * mean
        # The sums over all but the last and all but the first add up to this.
        product = c["products"] - mean * (2 * c["total"] - c["ends"]) + (n - 1) * mean * mean
        serial_p = F.when(squared > 0, 2 * _tail(F.abs((product / squared + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        least = F.least(_tail(uneven), run_p, serial_p)
        return F.struct(n.cast("int").alias("n"), F.least(3 * least, F.lit(1.0)).alias("p"))

    bare = F.regexp_replace(token, "=+$", "")
    return _once({"bare": bare}, lambda s: _once({"bare": s["bare"], "alphabet": _alphabet(s["bare"])}, lambda t: F.when(
        t["alphabet"].isNotNull(), _once({
            "alphabet": t["alphabet"], "places": F.transform(F.split(t["bare"], ""), lambda c: F.instr(t["alphabet"], c)),
        }, lambda u: _once(counted(u), measured)))))


def candidates(text: Column) -> Column:
    """array of (start, end, n, p, bin, length_class): tokens of 20 characters or
    more that hold a digit and a letter and fit an alphabet."""
    mixed = F.filter(matches(text, TOKEN), lambda r: r["match"].rlike("[0-9]") & r["match"].rlike("[A-Za-z]"))
    tested = F.transform(mixed, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _tests(r["match"]).alias("test")))
    return F.transform(F.filter(tested, lambda r: r["test"].isNotNull()), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"),
        F.floor(-F.log10(F.greatest(r["test"]["p"], F.lit(1e-30))) * _BINS).cast("int").alias("bin"),
        F.floor(2 * F.log2(r["test"]["n"].cast("double"))).cast("int").alias("length_class")))


def rejected_from(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length class, the least bin (higher bins are smaller p) from which
    a candidate counts as not random, by Benjamini and Hochberg's rule over all
    ``found`` (candidates). Each p is rounded up to its bin, so at most ``rate`` of
    the tokens that are turned away are expected to be random ones. There are a few
    dozen classes and at most 600 bins in each, whatever the data."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.length_class", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("length_class")
    ranked = rows.withColumn("rank", F.sum("n").over(same.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(same))
    cuts = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / _BINS) <= rate * F.col("rank") / F.col("all"))
    return {r[0]: r[1] for r in cuts.groupBy("length_class").agg(F.min("bin")).collect()}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) per row of ``docs`` (doc_id, text), from whole texts.

    ``base`` holds the spans (start, kind, end) of the three patterns and ``added``
    those of tokens that the tests leave standing as random and that touch no base
    span; kind counts in KINDS, and both are in the order of start, kind and end.
    Null and empty texts have none. Repeated rows and null ids stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = base_spans(text)
    found = docs.select(
        F.col("doc_id").cast("long"), F.array_sort(F.concat(*base.values())).alias("base"), candidates(text).alias("candidates"))
    found = cut_lineage(found)
    cuts = rejected_from(found)
    random = F.lit(True)
    if cuts:
        table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        random = lambda c: c["bin"] < F.coalesce(table[c["length_class"]], F.lit(1 << 30))
    standing = F.filter("candidates", random) if cuts else F.col("candidates")
    apart = F.filter(standing, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(_spans(3, apart)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: Column | str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def report(found: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, the hash of the base spans, and all spans."""
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"),
        F.size("added").cast("long").alias("n_random"))
