"""Secret scans in DataFrame functions alone: base patterns, and a battery of randomness tests with error control.

Places come from the texts between matches: what a pattern splits off, and what it matches, alternate, so their lengths
add up to every match's start. All places count code points, ends are exclusive. Each array is computed once and bound to a
lambda variable, and running sums are folded in blocks, so work is linear in a text's length and in its matches. A text is
scanned once: what was found is written to the shared folder, and the cutoffs are applied to that.

The battery looks at long unbroken tokens outside the base spans. It infers the encoding from the characters present
(hexadecimal, base32 and base36 in either case, base62, base64: the first alphabet that has them all), maps characters to
digits of that base and tests three ways in which text differs from random digits: chi-squared uniformity over the alphabet,
runs above and below its middle, and correlation of neighbours. A token that any test rejects is no secret. A token that
passes is one only with evidence against prose: the likelihood ratio of uniform digits to a fixed character model of text.
That ratio has mean 1 at most for prose, and is divided by the number of alphabets as the token chooses among them, so it is
an e-value; it grows with length. Within each class of lengths the step-up rule for e-values over all tokens of the corpus
keeps the false discovery rate at ``FDR`` whatever the dependence. Only a histogram of evidence by length class comes to the
driver.

Null texts are empty: no spans, and the hash of an empty string. An empty table gives no rows. Repeated rows are scanned as
often as they occur, and each counts in the histogram. Tokens of equal evidence share their verdict within a length class.
Extra columns are ignored by ``find_secrets``, also where their names differ from the wanted ones only in case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.session import materialize, pick

# Patterns and least lengths (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"  # runs are maximal, so the least length may stand in the pattern
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Which tokens an alphabet writes, smallest alphabet first; any other is base64.
ENCODINGS = ((16, "^([0-9a-f]+|[0-9A-F]+)$"), (32, "^([a-z2-7]+|[A-Z2-7]+)$"), (36, "^([a-z0-9]+|[A-Z0-9]+)$"), (62, "^[A-Za-z0-9]+$"))
#: Alphabets a token can be taken for: the four above in both cases but the last, and base64.
CHOICES = 8
#: Length classes of tokens, levels of the tests and of the false discovery rate.
LENGTHS, TEST_LEVEL, FDR = (32, 48, 96), 0.003, 0.01
#: What share of prose characters each class has, and the class's size (fixed values).
PROSE = (("[a-z]", 0.90, 26), ("[A-Z]", 0.04, 26), ("[0-9]", 0.04, 10), ("[+/_-]", 0.02, 4))


#: Elements that one level of a fold goes through.
BLOCK = 64
_PLACES = "array<struct<start:int,end:int,token:string>>"


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _fold(items: Column, zero: Column, kind: str, step) -> Column:
    """What ``step(state, item)``, a struct (state, emits), emits over all items, an array of type ``kind``.

    Growing an array copies it, so emitted elements are gathered by blocks.
    """

    def run(bound: Column) -> Column:
        def inner(state: Column, first: Column) -> Column:
            grow = lambda acc, x: _with(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["emits"]).alias("out")))
            return F.aggregate(F.slice(bound, first, F.lit(BLOCK)), F.struct(state.alias("state"), _none(kind).alias("out")), grow)

        def outer(acc: Column, first: Column) -> Column:
            return _with(inner(acc["state"], first), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["outs"], r["out"]).alias("outs")))

        start = F.struct(zero.alias("state"), _none(f"array<{kind}>").alias("outs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), F.lit(BLOCK)), start, outer)["outs"])

    return _with(items, run)


def _places(text: Column, pattern: str, matches: Column | None = None) -> Column:
    """array of (start, end, token) of all matches; ``matches`` has other texts to carry than the whole matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("token")))
    if matches is not None:
        sized = F.zip_with(sized, matches, lambda x, m: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), m.alias("token")))

    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("state"), F.array(F.struct(start.alias("start"), end.alias("end"), x["token"].alias("token"))).alias("emits"))

    return _fold(F.filter(sized, lambda x: x["size"].isNotNull()), F.lit(0), _PLACES, step)


def _spans(places: Column, kind: int, keep=None) -> Column:
    """Places as sortable (start, kind, end)."""
    made = lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"))
    return F.transform(places if keep is None else F.filter(places, keep), made)


_NONE = "array<struct<start:int,kind:int,end:int>>"


def _gated(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(_NONE))


def _tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal z, by a rational bound that is within 2 per cent."""
    x = F.abs(z)
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / (1.64 * x + F.sqrt(0.76 * x * x + 4)))


def _battery(token: Column) -> Column:
    """(encoding, p, evidence) of one token: least corrected p-value of the tests, and log10 of the e-value."""
    encoding, alphabet = F.lit(64), F.lit(ALPHABETS[64])
    for size, pattern in reversed(ENCODINGS):
        fits = token.rlike(pattern)
        encoding, alphabet = F.when(fits, size).otherwise(encoding), F.when(fits, F.lit(ALPHABETS[size])).otherwise(alphabet)
    chosen = F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), token.alias("token"))

    def digits(c: Column) -> Column:
        case = F.when(c["encoding"] == 16, F.lower(c["token"])).when(c["encoding"] <= 36, F.upper(c["token"])).otherwise(F.translate(c["token"], "-_", "+/"))
        found = _with(case, lambda own: F.transform(F.split(own, ""), lambda x: (F.instr(c["alphabet"], x) - 1).cast("double")))
        return _with(F.filter(found, lambda d: d >= 0), lambda ds: _tests(c["token"], c["encoding"], ds))

    return _with(chosen, digits)


def _named(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _tests(token: Column, encoding: Column, digits: Column) -> Column:
    """The tests from two passes: over the digits in order, and over them sorted."""
    zero = F.lit(0.0)
    k = encoding.cast("double")

    def ordered(a: Column, d: Column) -> Column:
        high = (d >= k / 2).cast("double")
        return _named(
            n=a["n"] + 1, sum=a["sum"] + d, square=a["square"] + d * d, ups=a["ups"] + high,
            changes=a["changes"] + F.when(a["n"] > 0, F.abs(high - a["high"])).otherwise(zero),
            pairs=a["pairs"] + a["last"] * d, last=d, high=high,
        )

    def grouped(a: Column, d: Column) -> Column:
        run = F.when(d == a["last"], a["run"] + 1).otherwise(F.lit(1.0))
        return _with(run, lambda r: _named(last=d, run=r, squares=a["squares"] + 2 * r - 1))

    sums = F.aggregate(digits, _named(n=zero, sum=zero, square=zero, ups=zero, changes=zero, pairs=zero, last=zero, high=zero), ordered)
    counts = F.aggregate(F.array_sort(digits), _named(last=F.lit(-1.0), run=zero, squares=zero), grouped)["squares"]

    def judged(x: Column) -> Column:
        n, s = x["n"], x["sums"]
        mean = s["sum"] / n
        # Uniformity: k/n times the sum of squared counts, less n; a cube-root transform makes it normal.
        df = k - 1
        z_chi = (F.pow(F.greatest(k / n * x["counts"] - n, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        # Runs above and below the middle of the alphabet.
        expected = 2 * s["ups"] * (n - s["ups"]) / n + 1
        z_runs = (s["changes"] + 1 - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        # Neighbours.
        square = F.greatest(s["square"] - n * mean * mean, F.lit(1e-9))
        pairs = s["pairs"] - mean * (2 * s["sum"] - F.get(digits, F.lit(0)) - s["last"]) + (n - 1) * mean * mean
        z_serial = (pairs / square + 1 / n) * F.sqrt(n)
        # Too many of one character speaks against randomness; too even a spread does not.
        p = 3 * F.least(_tail(F.greatest(z_chi, zero)), _tail(z_runs), _tail(z_serial))
        evidence = -n * F.log10(k) - math.log10(CHOICES)
        for characters, share, size in PROSE:
            evidence = evidence - F.length(F.regexp_replace(token, "[^" + characters[1:], "")) * math.log10(share / size)
        return _named(encoding=encoding, p=p, evidence=evidence)

    return _with(_named(n=F.length(token).cast("double"), sums=sums, counts=counts), judged)


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for least in LENGTHS:
        out = out + (n >= least).cast("int")
    return out


def _outside(base: Column, candidates: Column) -> Column:
    """The candidates, in order, that no base span overlaps: one pass over both by start.

    Candidates do not overlap each other, so a base span that begins within one comes before the next one.
    """
    kind = "struct<start:int,kind:int,end:int,token:string>"
    item = lambda s, which, token: _named(start=s["start"], kind=F.lit(which), end=s["end"], token=token)
    both = F.array_sort(
        F.concat(F.transform(base, lambda b: item(b, 0, F.lit(None).cast("string"))), F.transform(candidates, lambda c: item(c, 1, c["token"])))
    )
    last = F.array(item(_named(start=F.lit(2**31 - 1), end=F.lit(2**31 - 1)), 1, F.lit(None).cast("string")))  # lets the one before go
    zero = _named(covered=F.lit(0), waits=F.lit(None).cast(kind))

    def step(state: Column, x: Column) -> Column:
        waits, is_base = state["waits"], x["kind"] == 0
        free = (~is_base) & (x["start"] >= state["covered"])
        kept = F.when(is_base, F.when(waits["end"] <= x["start"], waits)).when(free, x)
        after = _named(covered=F.when(is_base, F.greatest(state["covered"], x["end"])).otherwise(state["covered"]), waits=kept)
        out = F.array(_named(start=waits["start"], end=waits["end"], token=waits["token"]))
        return _named(state=after, emits=F.when(~is_base & waits.isNotNull(), out).otherwise(_none(_PLACES)))

    return _fold(F.concat(both, last), zero, _PLACES, step)


def scan(text: Column) -> Column:
    """(base, candidates): sorted base spans, and tokens outside them with their test results."""
    assigned = F.filter(_places(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda p: F.length(p["token"]) >= LEAST_ASSIGN)
    assign = _gated(text.rlike(ASSIGN), _spans(assigned, 0))
    access = _gated(F.contains(text, F.lit("AKIA")), _spans(_places(text, ACCESS), 1))
    hexes = _gated(text.rlike(HEX), _spans(_places(text, HEX), 2))
    # One case of letters alone is a word, digits alone a number.
    coded = r"(?=.*[0-9])(?=.*[A-Za-z])|(?=.*[a-z])(?=.*[A-Z])"

    def tested(base: Column) -> Column:
        found = F.filter(_places(text, TOKEN), lambda t: t["token"].rlike(coded))
        outside = _with(found, lambda f: F.when(F.size(f) == 0, f).otherwise(_outside(base, f)))
        each = lambda c: _named(start=c["start"], end=c["end"], **{"class": _length_class(c["end"] - c["start"])}, test=_battery(c["token"]))
        none = _none("array<struct<start:int,end:int,class:int,test:struct<encoding:int,p:double,evidence:double>>>")
        return _named(base=base, candidates=F.when(text.rlike(TOKEN), F.transform(outside, each)).otherwise(none))

    return _with(F.array_sort(F.concat(assign, access, hexes)), tested)


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with columns base and candidates for the non-null string column ``text``, written to the shared folder."""
    found = docs.withColumn("found", scan(F.col("text")))
    return materialize(found.select(*docs.columns, "found.base", "found.candidates"), "scanned", few=True)


def evidence_cutoffs(scanned: DataFrame, fdr: float = FDR) -> list[float]:
    """For each length class, the least log10 evidence that counts, by the step-up rule for e-values.

    With m tokens of a class, the k with most evidence are discoveries if each has an e-value of m / (rate * k).
    Evidence is rounded down to tenths, so the histogram is small and the rule errs on the safe side.
    """
    classes = len(LENGTHS) + 1
    tokens = scanned.select(F.explode("candidates").alias("c")).select(
        F.col("c.class").alias("class"),
        F.when(F.col("c.test.p") >= TEST_LEVEL, F.least(F.greatest(F.floor(F.col("c.test.evidence") * 10), F.lit(-10)), F.lit(3000))).otherwise(-10).alias("bin"),
    )
    table = tokens.groupBy("class", "bin").count().collect()
    out = []
    for k in range(classes):
        bins = sorted(((r["bin"], r["count"]) for r in table if r["class"] == k), reverse=True)
        total, seen, best = sum(n for _, n in bins), 0, math.inf
        for value, n in bins:
            seen += n
            if value > 0 and value / 10 >= math.log10(total * classes / (fdr * seen)):
                best = value / 10
        out.append(best)
    return out


def find_secrets(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): sorted (start, kind, end), kinds numbered as in KINDS; base without the battery's spans."""
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("found", scan(F.coalesce("text", F.lit(""))))
    return _with_spans(materialize(src.select("doc_id", "found.base", "found.candidates"), "scanned"), fdr).select("doc_id", "base", "spans")


def _with_spans(scanned: DataFrame, fdr: float) -> DataFrame:
    cutoffs = F.array(*[F.lit(float(c)) for c in evidence_cutoffs(scanned, fdr)])
    surely = lambda c: (c["test"]["p"] >= TEST_LEVEL) & (F.floor(c["test"]["evidence"] * 10) / 10 >= F.get(cutoffs, c["class"]))
    random = _spans(F.filter("candidates", surely), 3)
    return scanned.withColumn("spans", F.array_sort(F.concat("base", random)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of its column ``text`` replaced by ``mark``; overlapping spans become one mark."""
    others = [c for c in docs.columns if c != "text"]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("text").alias("given"), F.coalesce("text", F.lit("")).alias("text"))
    found = _with_spans(_scanned(src), fdr)
    gap = "array<struct<start:int,end:int>>"

    def step(at: Column, span: Column) -> Column:
        before = F.array(_named(start=at, end=span["start"]))
        return _named(state=F.greatest(at, span["end"]), emits=F.when(span["start"] >= at, before).otherwise(_none(gap)))

    last = _named(start=F.array_max(F.transform("spans", lambda x: x["end"])), end=F.length("text"))
    kept = F.array_append(_fold(F.col("spans"), F.lit(0), gap, step), last)

    def joined(gaps: Column) -> Column:
        # A block's stretch is cut out of the text first, and its gaps out of that.
        def part(own: Column) -> Column:
            begin = F.get(own, F.lit(0))["start"]
            stretch = F.substring(F.col("text"), begin + 1, F.element_at(own, -1)["end"] - begin)
            return _with(stretch, lambda text: F.array_join(F.transform(own, lambda g: F.substring(text, g["start"] - begin + 1, g["end"] - g["start"])), mark))

        firsts = F.sequence(F.lit(1), F.size(gaps), F.lit(BLOCK))
        return F.array_join(F.transform(firsts, lambda i: _with(F.slice(gaps, i, F.lit(BLOCK)), part)), mark)

    out = F.when(F.size("spans") > 0, _with(kept, joined)).otherwise(F.col("given"))
    return found.withColumn("cleaned", out).select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])
