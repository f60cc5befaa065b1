"""Secret scanning with DataFrame functions only: three fixed patterns and a battery of randomness tests.

Every long token outside the fixed patterns' finds gets an encoding (digits, hexadecimal, letters, base 32, base 36,
base 64) and two questions.

Are its symbols drawn uniformly from that alphabet? Chi-squared over the symbols and over their classes (digits,
capitals, vowels, other letters), runs above and below the middle symbol, and serial correlation of neighbours; Fisher's
method combines their p-values. Tokens for which Benjamini and Hochberg's procedure rejects this are not secrets, so the
rate bounds the share of secrets among the tokens lost here.

Could it be ordinary text? The likelihood ratio of the uniform alphabet against a text model (how letters, capitals,
digits and signs follow each other, how common a letter is) has a mean of at most 1 over text, so its inverse bounds the
p-value of text by Markov's inequality, whatever the length: a short token must be the odder for it. The procedure runs
on these p-values too; only tokens for which text is rejected are reported, so the rate bounds the share of text-like
tokens among the finds. There is no minimal length but the pattern's 20.

Both procedures run within strata of length (powers of two). Their ranks come from a histogram of p-values over all
documents: at most 2 x 401 bins for each stratum, so what reaches the driver is bounded whatever the corpus holds.

Defined results: a null text is an empty one and has no spans; spans are in code points, end exclusive. Texts are
scanned whole. Repeated rows give repeated rows. An empty table gives no rows. Extra columns are not read by `scan`.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.running import LOT, largest_before, sums_before
from plumeline.functions.scoped import let
from plumeline.llm.common import fresh, whole_text

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: (name, pattern, alphabet) in order of preference.
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("letters", "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Classes of symbols for the coarse chi-squared test; what is in none of them is the last class.
CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiou")
# How often each letter of English text occurs, in thousandths, and how often a lower-case letter, a
# capital, a digit or a sign follows each of them in names, paths and text.
LETTERS = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24, "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}
FOLLOWS = ((0.88, 0.05, 0.02, 0.05), (0.55, 0.35, 0.05, 0.05), (0.08, 0.07, 0.70, 0.15), (0.55, 0.20, 0.20, 0.05))
SYMBOLS = ENCODINGS[-1][2]
#: Histogram of p-values: 20 bins for each factor of ten, down to 1e-20.
BINS_PER_DECADE, LAST_BIN = 20, 400



def text_model() -> tuple[list[int], list[float], list[float]]:
    """For each of SYMBOLS its kind (0 lower, 1 capital, 2 digit, 3 sign) and log-probability within the kind; for each pair of kinds (4 x before + after) the log-probability of the step."""
    kinds = [0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 3 for s in SYMBOLS]
    signs, letters = kinds.count(3), sum(LETTERS.values())
    within = [log(LETTERS[s.lower()] / letters) if k < 2 else -log(10 if k == 2 else signs) for s, k in zip(SYMBOLS, kinds, strict=True)]
    return kinds, within, [log(p) for row in FOLLOWS for p in row]


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """A pattern's matches as array<struct<start,end,text,value>>: what `split` leaves between them gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("text"), values.alias("value"))
    rows = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["text"]).alias("length"), x["text"].alias("text"), x["value"].alias("value")))

    def placed(v: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(v["at"], i).cast("int") + x["gap"]
            return F.struct(start.alias("start"), (start + x["length"]).alias("end"), x["text"].alias("text"), x["value"].alias("value"))

        return F.transform(v["rows"], span)

    return let(lambda r: let(placed, rows=r["rows"], at=sums_before(F.transform(r["rows"], lambda x: x["gap"] + x["length"]))), rows=rows)


def _located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of those matches of which `group` has a least length."""
    found = F.filter(_matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _base_spans(text: Column) -> Column:
    signs = text.contains("=") | text.contains(":")
    assign = F.when(signs, _located(text, ASSIGN, 0, group=2, least=6)).otherwise(F.array().cast(_SPAN))
    return F.array_sort(F.concat(assign, _located(text, ACCESS, 1), _located(text, HEX, 2)))


def _log_tails(scores: Column) -> Column:
    """Scores of a standard normal variable, array<struct<z,sides>> -> ln P(Z > z) * sides of each (Abramowitz and Stegun 26.2.17).

    Each step is a transform of its own, so that what it reads twice is computed once.
    """
    near = F.transform(scores, lambda s: F.struct(s["z"].alias("z"), s["sides"].alias("sides"), F.least(F.abs(s["z"]), F.lit(37.0)).alias("a")))
    near = F.transform(near, lambda s: F.struct(s["z"].alias("z"), s["sides"].alias("sides"), s["a"].alias("a"), (1 / (1 + 0.2316419 * s["a"])).alias("t")))

    def tail(s: Column) -> Column:
        t = s["t"]
        upper = F.exp(-s["a"] * s["a"] / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct(s["z"].alias("z"), s["sides"].alias("sides"), upper.alias("upper"))

    return F.transform(F.transform(near, tail), lambda s: F.log(F.greatest(F.when(s["z"] >= 0, s["upper"]).otherwise(1 - s["upper"]) * s["sides"], F.lit(1e-30))))


def _bin(log_p: Column) -> Column:
    """The histogram bin of a p-value, by its decimal logarithm; small ones have large bins."""
    return F.greatest(F.lit(0), F.least(F.lit(LAST_BIN), F.floor(-log_p * BINS_PER_DECADE).cast("int")))


def _tested(tokens: Column) -> Column:
    """array<struct<start,end,text>> -> array<struct<start,end,stratum,uneven,odd>>: bins of p-values, of uniform symbols and of text."""

    def encoded(c: Column) -> Column:
        alphabet = F.lit(ENCODINGS[-1][2])
        for _, pattern, symbols in reversed(ENCODINGS[:-1]):
            alphabet = F.when(c["text"].rlike(pattern), F.lit(symbols)).otherwise(alphabet)
        plain = F.when(c["text"].rlike(ENCODINGS[0][1]) | c["text"].rlike(ENCODINGS[1][1]) | c["text"].rlike(ENCODINGS[2][1]) | c["text"].rlike(ENCODINGS[3][1]) | c["text"].rlike(ENCODINGS[4][1]), F.lower(c["text"])).otherwise(c["text"])
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), plain.alias("text"), alphabet.alias("alphabet"))

    def counted(c: Column) -> Column:
        symbols = F.split(c["text"], "")

        def classes(x: Column) -> list[Column]:
            inside = [(F.length(x) - F.length(F.translate(x, members, ""))).cast("double") for members in CLASSES]
            return [*inside, F.length(x) - inside[0] - inside[1] - inside[2]]

        pairs = F.arrays_zip(F.array(*classes(c["text"])).alias("seen"), F.array(*classes(c["alphabet"])).alias("size"))
        n = F.length(c["text"]).cast("double")
        squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda acc, s: acc + F.pow(n - F.length(F.replace(c["text"], s, F.lit(""))), F.lit(2.0)))
        places = F.transform(symbols, lambda s: F.call_function("instr", c["alphabet"], s).cast("double"))
        signs = F.transform(symbols, lambda s: F.call_function("instr", F.lit(SYMBOLS), s))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), F.length(c["alphabet"]).cast("double").alias("k"), squares.alias("squares"), places.alias("at"), pairs.alias("classes"), signs.alias("signs"))

    def compared(c: Column) -> Column:
        """ln of the likelihood under the uniform alphabet over that under the text model."""
        kinds, within, steps = (F.array(*map(F.lit, x)) for x in text_model())

        def follow(a: Column, i: Column) -> Column:
            kind = F.element_at(kinds, i)
            step = F.when(a["kind"] < 0, F.lit(-log(4))).otherwise(F.element_at(steps, F.greatest(4 * a["kind"] + kind + 1, F.lit(1))))
            return F.struct(kind.alias("kind"), (a["sum"] + step + F.element_at(within, i)).alias("sum"))

        text = F.aggregate(c["signs"], F.struct(F.lit(-1).alias("kind"), F.lit(0.0).alias("sum")), follow, lambda a: a["sum"])
        return F.struct(*[c[x].alias(x) for x in ("start", "end", "n", "k", "squares", "at", "classes")], (-c["n"] * F.log(c["k"]) - text).alias("odds"))

    def summed(c: Column) -> Column:
        middle = (c["k"] + 1) / 2
        zero = F.struct(*[F.lit(0.0).alias(x) for x in ("last", "high", "runs", "sum", "sq", "lag")])

        def step(a: Column, x: Column) -> Column:
            crossed = (a["last"] == 0) | ((a["last"] > middle) != (x > middle))
            return F.struct(x.alias("last"), (a["high"] + (x > middle).cast("double")).alias("high"), (a["runs"] + crossed.cast("double")).alias("runs"), (a["sum"] + x).alias("sum"), (a["sq"] + x * x).alias("sq"), (a["lag"] + a["last"] * x).alias("lag"))

        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["k"].alias("k"), c["squares"].alias("squares"), c["classes"].alias("classes"), F.aggregate(c["at"], zero, step).alias("s"), c["at"][0].alias("first"), c["odds"].alias("odds"))

    def measured(c: Column) -> Column:
        n, k, s = c["n"], c["k"], c["s"]
        low = n - s["high"]
        used = F.filter(c["classes"], lambda x: x["size"] > 0)
        coarse = F.aggregate(used, F.lit(0.0), lambda a, x: a + x["seen"] * x["seen"] * k / (n * x["size"])) - n
        mean = s["sum"] / n
        around = s["lag"] - mean * (2 * s["sum"] - c["first"] - s["last"]) + (n - 1) * mean * mean
        values = {"start": c["start"], "end": c["end"], "n": n, "k": k, "chi": k / n * c["squares"] - n, "coarse": coarse, "wide": F.size(used) - 1, "runs": s["runs"], "expected": 1 + 2 * s["high"] * low / n, "around": around, "variance": s["sq"] - n * mean * mean, "odds": c["odds"]}
        return F.struct(*[v.alias(name) for name, v in values.items()])

    def scored(c: Column) -> Column:
        def cube(x: Column, df: Column) -> Column:  # Wilson and Hilferty
            return (F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

        spread = (c["expected"] - 1) * (c["expected"] - 2) / (c["n"] - 1)
        coarse = F.when(c["wide"] > 0, cube(c["coarse"], c["wide"])).otherwise(F.lit(0.0))
        runs = F.when(spread > 0, F.abs(c["runs"] - c["expected"]) / F.sqrt(spread)).otherwise(F.lit(37.0))
        serial = F.when(c["variance"] > 1e-9, F.abs(c["around"] / c["variance"] + 1 / c["n"]) * F.sqrt(c["n"])).otherwise(F.lit(37.0))
        scores = F.array(*[F.struct(z.alias("z"), F.lit(sides).alias("sides")) for z, sides in ((cube(c["chi"], c["k"] - 1), 1.0), (coarse, 1.0), (runs, 2.0), (serial, 2.0))])
        half = -F.aggregate(_log_tails(scores), F.lit(0.0), lambda a, x: a + x)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["odds"].alias("odds"), half.alias("half"))

    def judged(c: Column) -> Column:
        n, half, ten = c["n"], c["half"], F.log(F.lit(10.0))
        log_p = (-half + F.log(1 + half + half * half / 2 + half * half * half / 6)) / ten  # chi-squared, 8 degrees
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.floor(F.log2(n)).cast("int").alias("stratum"), _bin(log_p).alias("uneven"), _bin(-c["odds"] / ten).alias("odd"))

    for f in (encoded, counted, compared, summed, measured, scored, judged):
        tokens = F.transform(tokens, f)
    return tokens


def _tokens(text: Column) -> Column:
    """Candidate tokens with their texts."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    tokens = F.transform(_matches(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))
    return F.when(text.rlike(TOKEN), tokens).otherwise(none)


def rejection_bins(documents: DataFrame, rate: float) -> dict[str, dict[int, int]]:
    """For `uneven` and `odd`, by length stratum: the first bin of p-values that is rejected at false-discovery rate `rate`."""
    tested = documents.select(F.explode(_tested(_tokens(whole_text()))).alias("t"))
    both = F.array(*[F.struct(F.lit(test).alias("test"), F.col(f"t.{test}").alias("bin")) for test in ("uneven", "odd")])
    rows = tested.select("t.stratum", F.explode(both).alias("b")).select("stratum", "b.test", "b.bin")
    counts = rows.groupBy("test", "stratum", "bin").agg(F.count("*").alias("n"))  # <= strata x 2 x 401 rows
    w = Window.partitionBy("test", "stratum")
    at_most = F.sum("n").over(w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    passed = counts.withColumn("_ok", edge <= rate * at_most / F.sum("n").over(w)).filter("_ok")
    found: dict[str, dict[int, int]] = {"uneven": {}, "odd": {}}
    for r in passed.groupBy("test", "stratum").agg(F.min("bin").alias("first")).collect():
        found[r.test][r.stratum] = r.first
    return found


def _spans(text: Column, bins: dict[str, dict[int, int]]) -> tuple[Column, Column]:
    """(base spans, random spans) columns."""

    def first(test: str, stratum: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in (bins[test] or {-1: 0}).items() for x in kv])
        return F.coalesce(F.try_element_at(known, stratum), F.lit(LAST_BIN + 1))

    base = _base_spans(text)
    kept = F.filter(_tested(_tokens(text)), lambda t: (t["odd"] >= first("odd", t["stratum"])) & (t["uneven"] < first("uneven", t["stratum"])))
    return base, F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def with_spans(documents: DataFrame, rate: float = 0.05, base: str = "_base", every: str = "_all") -> DataFrame:
    """The documents with two arrays of (start, kind, end) in order: the base spans and all spans."""
    fixed, random = _spans(whole_text(), rejection_bins(documents, rate))
    more = fresh([*documents.columns, base, every], "_random")
    out = documents.withColumn(base, fixed).withColumn(more, random)
    return out.withColumn(every, F.when(F.size(more) == 0, F.col(base)).otherwise(_with_apart(F.col(base), F.col(more)))).drop(more)


def _with_apart(base: Column, more: Column) -> Column:
    """The base spans and those of `more` that no base span holds, in order; both are sorted once and read once."""
    both = F.array_sort(F.concat(base, more))  # at one start the base spans come first: their kinds are smaller

    def kept(v: Column) -> Column:
        inside = F.transform(v["both"], lambda s, i: F.struct(s.alias("span"), ((s["kind"] == 3) & (F.get(v["reach"], i) >= s["end"])).alias("held")))
        return F.transform(F.filter(inside, lambda x: ~x["held"]), lambda x: x["span"])

    ends = lambda both: F.transform(both, lambda s: F.when(s["kind"] == 3, 0).otherwise(s["end"]))
    return let(lambda b: let(kept, both=b["both"], reach=largest_before(ends(b["both"]))), both=both)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(documents: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, the number of finds by kind, the digest of the base spans and all spans as text."""
    found = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rate)

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by `mark`, and `n_chars` to match; all columns stay."""
    base, every = (fresh(documents.columns, c) for c in ("_base", "_all"))
    out = with_spans(documents, rate, base, every)
    found = F.size(every) > 0
    out = out.withColumn("text", F.when(found, F.array_join(_outside(F.col("text"), F.col(every)), mark)).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def _outside(text: Column, spans: Column) -> Column:
    """What lies before, between and behind the spans, which are in order and may overlap.

    A text is cut into lots of pieces first and these into pieces, since to find a place reads all that is before it.
    """
    piece = "array<struct<start:int,end:int>>"

    def gaps(v: Column) -> Column:
        new = F.transform(v["spans"], lambda s, i: F.struct(F.get(v["reach"], i).cast("int").alias("start"), s["start"].alias("end"), ((i == 0) | (F.get(v["reach"], i) < s["start"])).alias("new")))
        last = F.array(F.struct(F.element_at(v["reach"], -1).cast("int").alias("start"), F.length(v["text"]).alias("end")))
        return F.concat(F.transform(F.filter(new, lambda g: g["new"]), lambda g: F.struct(g["start"], g["end"])).cast(piece), last.cast(piece))

    def cut(v: Column) -> Column:
        def lot(at: Column) -> Column:
            first, until = at * LOT, F.least(at * LOT + LOT, F.size(v["gaps"])) - 1
            begin, end = F.get(v["gaps"], first)["start"], F.get(v["gaps"], until)["end"]
            one = lambda w: F.transform(F.sequence(w["first"], w["until"]), lambda i: F.substring(w["part"], F.get(v["gaps"], i)["start"] - w["begin"] + 1, F.get(v["gaps"], i)["end"] - F.get(v["gaps"], i)["start"]))
            return let(one, first=first, until=until, begin=begin, part=F.substring(v["text"], begin + 1, end - begin))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(v["gaps"]) - 1) / LOT).cast("int")), lot))

    reach = largest_before(F.transform(spans, lambda s: s["end"]))
    return let(lambda v: let(cut, text=v["text"], gaps=gaps(v)), text=text, spans=spans, reach=reach)
