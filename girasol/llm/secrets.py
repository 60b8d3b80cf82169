"""Secret scan in DataFrame functions only: fixed patterns, and a battery of randomness tests.

Every run of 20 or more base-64 characters with a digit and a letter is a candidate. Its
encoding is inferred (hexadecimal, base 32, 36, 62 or 64) and three tests ask
whether its symbols look drawn at random: chi-squared uniformity over the alphabet, the
number of runs above and below the alphabet's middle, and lag-one serial correlation.
Fisher's method combines them, and candidates that are found not to be random are discarded.
A fourth test, of uniformity again, asks the opposite: how often letters of ordinary words,
as names and paths are made of, would be as evenly spread as the candidate's. The secrets are
those whose ordinary origin is rejected. Both decisions are false-discovery procedures
(Benjamini-Hochberg) of their own in each band of lengths, as short candidates have less power.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns, and the least length of what they must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches as HEX keeps of 24 characters and more: runs are maximal either way.
LONG_HEX = r"[0-9a-f]{24,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: How many of 1000 letters of English text are a, b, ... z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Matches a chunk when places of matches are summed up.
CHUNK = 256
#: Lengths from which the bands of the false-discovery control begin.
BANDS = (20, 28, 40, 64, 128)
#: Bins of the combined p's negative decimal logarithm: width, and number a band.
BIN, BINS = 0.01, 1500


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, kind, end) of a pattern's leftmost matches that do not overlap, in code
    points. Matches alternate with the gaps that split() leaves, so lengths give places.
    ``keep`` takes a match's number."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def step(acc: Column, both: Column) -> Column:
        start = acc["at"] + both["gap"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + both["size"]).alias("end"))
        return F.struct((start + both["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), _none().alias("out")), step, lambda acc: acc["out"])

    def moved(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["size"])

    pairs = F.filter(F.zip_with(gaps, lengths, lambda g, m: F.struct(g.alias("gap"), m.alias("size"))), lambda x: x["size"].isNotNull())
    # An array that grows is copied at every step, so matches are summed up chunk by chunk.
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
    ends = F.aggregate(
        F.transform(chunks, moved), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    many = F.flatten(F.transform(chunks, lambda part, i: run(part, F.get(ends, i))))
    found = F.when(F.size(lengths) <= CHUNK, run(pairs, F.lit(0))).otherwise(many)
    if keep is not None:
        found = F.filter(found, lambda x, i: keep(i))
    return F.when(text.rlike(pattern), found).otherwise(_none())


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind. The text must not be null."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = _spans(text, ASSIGN, 0, lambda i: F.length(F.get(values, i)) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, LONG_ACCESS, 1), _spans(text, LONG_HEX, 2)))


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to about 1e-5 (a fixed rational approximation)."""
    x = F.abs(z)
    t = 1 / (1 + 0.33267 * x)
    upper = 0.3989422804 * F.exp(-x * x / 2) * (0.4361836 * t - 0.1201676 * t * t + 0.9372980 * t * t * t)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _symbols(token: Column) -> Column:
    """struct<k, v>: the size of the inferred alphabet, and each symbol's place in it."""
    body = F.regexp_replace(token, "=+", "")
    hexadecimal, base32 = body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), body.rlike("^[A-Z2-7]+$")
    base36 = body.rlike("^([0-9a-z]+|[0-9A-Z]+)$")
    alphabet = F.when(hexadecimal, "0123456789abcdef").when(base32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567").when(base36, "0123456789abcdefghijklmnopqrstuvwxyz").otherwise(BASE64)
    plain = F.when(hexadecimal | (~base32 & base36), F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    k = F.when(hexadecimal, 16).when(base32, 32).when(base36, 36).when(body.rlike("[+/_-]"), 64).otherwise(62)
    return F.struct(k.cast("double").alias("k"), F.transform(F.split(plain, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")).alias("v"))


def _sum(values: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _ordinary(token: Column, k: Column) -> Column:
    """Decimal logarithm of how likely letters of ordinary words are to be as evenly spread as the
    token's, and, in a hexadecimal token, to be all from a to f; 0 without letters."""
    table = F.array(*[F.lit(float(x)) for x in LETTERS])
    letters = F.filter(F.split(F.lower(token), ""), lambda c: c.rlike("^[a-z]$"))
    m = F.size(letters).cast("double")

    def likely(own: tuple[int, ...]) -> Column:
        """A letter of share q among n counts -log(n q); the sum is about normal."""
        n, total = len(own), float(sum(own))
        gains = [(x / total, -math.log(n * x / total)) for x in own]
        mean = sum(q * g for q, g in gains)
        spread = math.sqrt(sum(q * (g - mean) ** 2 for q, g in gains))
        found = F.aggregate(letters, F.lit(0.0), lambda a, c: a - F.log(F.get(table, F.ascii(c) - 97) * (n / total)))
        z = (found - m * mean) / (F.sqrt(F.greatest(m, F.lit(1.0))) * spread)
        return F.log10(F.greatest(_tail(z), F.lit(1e-15))) + m * math.log10(total / sum(LETTERS))

    return F.when(m == 0, 0.0).when(k == 16, likely(LETTERS[:6])).otherwise(likely(LETTERS))


def _bin(x: Column) -> Column:
    return F.least(F.floor(F.greatest(x, F.lit(0.0)) / BIN), F.lit(BINS)).cast("int")


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds __girasol_tested, an array with a struct for each candidate in __girasol_text: its span, its
    symbols' number n, the bins of -log10 of the combined p that it is random and of the p that it is
    made of ordinary letters, and its length's band.

    Each step adds a field to the structs, so that no candidate leaves its row.
    """
    text = F.col("__girasol_text")
    own = docs.withColumn("__girasol_tested", F.transform(
        _spans(text, CANDIDATE, 3), lambda s: F.struct(s.alias("span"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"))
    ))
    own = own.withColumn("__girasol_tested", F.filter("__girasol_tested", lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]")))

    def add(**fields: Callable[[Column], Column]) -> None:
        nonlocal own
        own = own.withColumn("__girasol_tested", F.transform("__girasol_tested", lambda c: F.struct(
            *[c[x].alias(x) for x in held], *[f(c).alias(name) for name, f in fields.items()]
        )))
        held.extend(fields)

    held = ["span", "token"]
    add(s=lambda c: _symbols(c["token"]))
    add(k=lambda c: c["s"]["k"], v=lambda c: c["s"]["v"], n=lambda c: F.size(c["s"]["v"]).cast("double"))
    add(
        squares=lambda c: _sum(F.array_distinct(c["v"]), lambda x: F.pow(F.size(F.filter(c["v"], lambda y: y == x)).cast("double"), F.lit(2.0))),
        mean=lambda c: _sum(c["v"]) / c["n"],
        high=lambda c: _sum(c["v"], lambda x: F.when(x >= c["k"] / 2, 1.0).otherwise(0.0)),
        pairs=lambda c: F.zip_with(
            F.slice(c["v"], 1, F.size(c["v"]) - 1), F.slice(c["v"], 2, F.size(c["v"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    add(
        runs=lambda c: 1 + _sum(c["pairs"], lambda p: F.when((p["a"] >= c["k"] / 2) != (p["b"] >= c["k"] / 2), 1.0).otherwise(0.0)),
        cov=lambda c: _sum(c["pairs"], lambda p: (p["a"] - c["mean"]) * (p["b"] - c["mean"])),
        var=lambda c: _sum(c["v"], lambda x: (x - c["mean"]) * (x - c["mean"])),
        expect=lambda c: 2 * c["high"] * (c["n"] - c["high"]) / c["n"] + 1,
    )
    add(
        chi_z=lambda c: (c["k"] * c["squares"] / c["n"] - c["n"] - (c["k"] - 1)) / F.sqrt(2 * (c["k"] - 1) * (c["n"] - 1) / c["n"]),
        runs_z=lambda c: F.when(
            c["expect"] > 2, (c["runs"] - c["expect"]) / F.sqrt(F.greatest((c["expect"] - 1) * (c["expect"] - 2) / (c["n"] - 1), F.lit(1e-9)))
        ).otherwise(-F.sqrt(c["n"])),
        serial_z=lambda c: F.when(c["var"] > 0, (c["cov"] / F.greatest(c["var"], F.lit(1e-9)) + 1 / c["n"]) * F.sqrt(c["n"])).otherwise(F.sqrt(c["n"])),
    )
    own = own.withColumn("__girasol_tested", F.filter("__girasol_tested", lambda c: c["n"] >= 2))
    add(half=lambda c: -sum(
        (F.log(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))) for p in (_tail(c["chi_z"]), 2 * _tail(F.abs(c["runs_z"])), 2 * _tail(F.abs(c["serial_z"])))),
        F.lit(0.0),
    ))
    held = ["span", "n"]
    add(
        bin=lambda c: _bin((c["half"] - F.log(1 + c["half"] + c["half"] * c["half"] / 2)) / F.log(F.lit(10.0))),
        odd=lambda c: _bin(-_ordinary(c["token"], c["k"])),
        band=lambda c: _band(c["n"]),
    )
    return own


def cutoffs(tested: DataFrame, rate: float) -> dict[str, dict[int, int]]:
    """For each null hypothesis (bin: drawn at random; odd: made of ordinary letters) and band of
    lengths, the least bin in which it is rejected.

    Candidates are counted by band and bin first, so at most 2 x 5 x 1501 rows reach the last
    step and ten the driver, however many candidates there are.
    """
    one = tested.select(F.explode("__girasol_tested").alias("c")).select(
        F.col("c.band").alias("band"), F.explode(F.array(*[F.struct(F.lit(x).alias("null"), F.col(f"c.{x}").alias("bin")) for x in ("bin", "odd")])).alias("x")
    ).select("band", "x.*")
    counts = one.groupBy("null", "band", "bin").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("null", "band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("c").over(down)).withColumn("m", F.sum("c").over(Window.partitionBy("null", "band")))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * BIN) <= rate * F.col("rank") / F.col("m"))
    out: dict[str, dict[int, int]] = {"bin": {}, "odd": {}}
    for r in passed.groupBy("null", "band").agg(F.min("bin").alias("b")).collect():
        out[r["null"]][r["band"]] = r["b"]
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, rate: float = 0.05) -> DataFrame:
    """Adds _base and _added (arrays of struct<start, kind, end>, code points, end exclusive,
    kind an index of KINDS) to every row, whatever its id.

    A null text is empty. Added spans lie in no base span. The false-discovery rate ``rate`` holds
    over the candidates of all rows of ``docs``: of what is reported, for candidates made of
    ordinary letters; of what is discarded, for random ones. Rows that repeat are candidates each
    time. Columns named _base and _added are replaced; others pass through.
    """
    source = docs.withColumn("__girasol_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    tested = with_candidates(source)
    limits = cutoffs(with_candidates(source.select("__girasol_text")), rate)
    limit, least = (F.create_map(*[F.lit(x) for b in range(len(BANDS)) for x in (b, limits[null].get(b, BINS + 1))]) for null in ("bin", "odd"))
    found = tested.withColumn("_base", base_spans(F.col("__girasol_text")))

    def inside(s: Column) -> Column:
        return F.exists(F.col("_base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    fresh = F.filter("__girasol_tested", lambda c: (c["bin"] < F.element_at(limit, c["band"])) & (c["odd"] >= F.element_at(least, c["band"])) & ~inside(c["span"]))
    return found.withColumn("_added", F.transform(fresh, lambda c: c["span"])).drop("__girasol_text", "__girasol_tested")


def digest(found: DataFrame) -> DataFrame:
    """One row a document, from find_secrets()."""
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
    )
