r"""Secrets in texts: fixed forms, and runs that pass a battery of randomness tests, with DataFrame functions only.

Fixed forms are ``assign`` (a key word, ``:`` or ``=`` and a value of 12 characters or more), ``access`` (``AKIA`` and
capitals or digits, 18 characters or more) and ``hex`` (16 or more hexadecimal digits). Matches of a form are leftmost
and do not overlap; a match that is too short is dropped, but what it covers is not searched again.

Of kind ``random`` are runs of 16 or more characters of the base64 alphabets that meet no fixed form. The narrowest
alphabet that holds a run is its encoding. Against the hypothesis that the run is uniform over that alphabet stand
a chi-squared test of its characters, a runs test about the middle of the alphabet and the serial correlation of
neighbouring places; Fisher's method joins the three, and a run that they reject is no secret. Against the hypothesis
that the run is ordinary stands the number of equal pairs of its characters, whose mean and variance for this length
follow from the characters of all other runs of the corpus. Short runs cannot depart far from it, so the length decides how
small a p-value can be. Benjamini-Hochberg holds the share of false discoveries at ``rate`` within each encoding and
doubling of the length, over all texts.

Cases: a null text is empty and has no spans; repeated rows and ids are rows of their own; a corpus whose ordinary
runs look random, or has none, gives no ``random`` spans; empty tables give empty results; columns beyond doc_id and
text are not carried along. Positions count code points from 0, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty, stored
from tokenloom.operators.skew import running_total

RATE = 0.01
#: Joint p-value of the battery below which a run is not uniform.
REJECTED = 0.001
LEAST = 16

#: Kinds in the order of the report and their patterns; the group that must be long, and how long.
_FORMS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "random": (r"[A-Za-z0-9+/_-]{%d,}" % LEAST, 0, LEAST),
}
KINDS = list(_FORMS)
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, narrowest first.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + _LOWER[:6],
    "upper hex": _DIGITS + _LOWER[:6].upper(),
    "base32": _LOWER.upper() + "234567",
    "lower": _LOWER + _DIGITS,
    "upper": _LOWER.upper() + _DIGITS,
    "base62": _LOWER.upper() + _LOWER + _DIGITS,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}


def _matches(kind: str) -> Column:
    """Per match of a form: characters since the match before it, its own, its length test, and a run's text."""
    pattern, group, least = _FORMS[kind]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split("text", pattern, -1), lambda gap: F.length(gap))
    tested = found if group == 0 else F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(found.alias("match"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), tested.alias("tested")),
        lambda row: F.struct(
            F.lit(kind).alias("kind"),
            row["gap"].alias("gap"),
            F.length(row["match"]).alias("size"),
            (F.length(row["tested"]) >= least).alias("fits"),
            (row["match"] if kind == "random" else F.lit(None).cast("string")).alias("run"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,size:int,fits:boolean,run:string>>")
    return F.when(F.col("text").rlike(pattern), rows).otherwise(none)


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution: a polynomial near the middle, a continued fraction beyond."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * x)
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = x
    for step in range(12, 0, -1):
        far = x + step / far
    upper = F.when(x < 2.5, near).otherwise(density / far)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def _battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, n (characters), pairs (equal pairs) and uniform (joint p-value against uniformity)."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(ENCODINGS):
        inside = F.length(F.translate("run", ENCODINGS[name], "")) == 0
        encoding = F.when(inside, name).otherwise(encoding)
        alphabet = F.when(inside, F.lit(ENCODINGS[name])).otherwise(alphabet)
    runs = runs.withColumns({"encoding": encoding, "alphabet": alphabet}).where("encoding IS NOT NULL")
    places = F.transform(F.split("run", ""), lambda char: F.instr(F.col("alphabet"), char).cast("double"))
    once = runs.withColumns(
        {
            "n": F.length("run").cast("double"),
            "k": F.length("alphabet").cast("double"),
            "places": F.filter(places, lambda place: place > 0),
            "sizes": F.transform(
                F.filter(F.split("alphabet", ""), lambda char: char != ""),
                lambda char: (F.length("run") - F.length(F.replace("run", char, F.lit("")))).cast("double"),
            ),
        }
    )
    add = lambda values, change: F.aggregate(values, F.lit(0.0), lambda total, value: total + change(value))
    n, k = F.col("n"), F.col("k")
    high = F.col("k") / 2
    changes = F.zip_with(
        F.slice("places", F.lit(1), F.size("places") - 1),
        F.slice("places", F.lit(2), F.size("places") - 1),
        lambda one, other: F.struct(
            ((one > high) != (other > high)).cast("double").alias("change"), (one * other).alias("product")
        ),
    )
    sums = once.withColumns(
        {
            "pairs": add(F.col("sizes"), lambda size: size * (size - 1) / 2),
            "mean": add(F.col("places"), lambda place: place) / n,
            "squares": add(F.col("places"), lambda place: place * place),
            "upper": add(F.col("places"), lambda place: (place > high).cast("double")),
            "changes": changes,
            "ends": F.element_at("places", 1) + F.element_at("places", -1),
        }
    )
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    chi = F.greatest(k / n * (n + 2 * F.col("pairs")) - n, F.lit(0.0))
    share = 2 / (9 * (k - 1))
    p_chi = _tail((F.pow(chi / (k - 1), 1 / 3) - (1 - share)) / F.sqrt(share))
    crossing = add(F.col("changes"), lambda row: row["change"]) + 1
    both = 2 * F.col("upper") * (n - F.col("upper"))
    spread = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(spread > 0, 2 * _tail(F.abs(crossing - both / n - 1) / F.sqrt(spread))).when(
        # All places in one half: two to the power of 1 - n of all uniform runs are so.
        both == 0, F.pow(F.lit(2.0), 1 - n)
    ).otherwise(1.0)
    mean = F.col("mean")
    products = add(F.col("changes"), lambda row: row["product"]) - mean * (2 * n * mean - F.col("ends")) + (n - 1) * mean * mean
    deviation = F.col("squares") - n * mean * mean
    p_serial = F.when(deviation > 0, 2 * _tail(F.abs(products / deviation + 1 / n) * F.sqrt(n))).otherwise(0.0)
    least = lambda p: F.ln(F.greatest(p, F.lit(1e-300)))
    half = -(least(p_chi) + least(p_runs) + least(p_serial))
    return sums.select(*runs.columns, "n", "pairs", (F.exp(-half) * (1 + half + half * half / 2)).alias("uniform"))


def _ordinary(runs: DataFrame) -> DataFrame:
    """Per encoding the chance that two (three) characters of ordinary runs are equal, from all runs' characters."""
    chars = runs.select(F.explode(F.split("run", "")).alias("char")).groupBy("char").agg(F.count("*").cast("double").alias("c"))
    listed = F.array(*[F.struct(F.lit(name).alias("encoding"), F.lit(text).alias("text")) for name, text in ENCODINGS.items()])
    alphabets = (
        chars.select("char", "c", F.explode(listed).alias("of"))
        .where((F.col("char") != "") & (F.instr(F.col("of.text"), F.col("char")) > 0))
        .groupBy(F.col("of.encoding").alias("encoding"))
    )
    c, total = F.col("c"), F.sum("c")
    return alphabets.agg(
        F.when(total > 2, F.sum(c * (c - 1)) / (total * (total - 1))).alias("two"),
        F.when(total > 2, F.sum(c * (c - 1) * (c - 2)) / (total * (total - 1) * (total - 2))).alias("three"),
    )


def _discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """Rows whose ``p`` is within Benjamini-Hochberg's bound of their stratum; nothing is ranked above ``rate``."""
    strata = tested.groupBy("stratum").agg(F.count("*").alias("m"))
    values = tested.where(F.col("p") <= rate).groupBy("stratum", "p").agg(F.count("*").alias("here"))
    ranked = running_total(values, F.col("here"), ["stratum", "p"], total="before")
    firsts = ranked.groupBy("stratum").agg(F.min("before").alias("start"))
    bounds = (
        ranked.join(firsts, "stratum")
        .join(strata, "stratum")
        .where(F.col("p") * F.col("m") <= rate * (F.col("before") - F.col("start") + F.col("here")))
        .groupBy("stratum")
        .agg(F.max("p").alias("bound"))
    )
    # At most one row per encoding and doubling of the length.
    return tested.join(F.broadcast(bounds), "stratum").where("p <= bound")


def _spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, fits, run) of all matches, from their lengths and gaps."""
    each = rows.select("row", F.posexplode("matches").alias("at", "m")).select("row", "at", "m.*")
    along = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(along)
    return each.select("row", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "fits", "run").where("fits").drop("fits")


def random_runs(spans: DataFrame, *, rate: float = RATE) -> DataFrame:
    """Of the runs that meet no fixed form, (row, kind, start, end) of those that are discovered."""
    fixed = spans.where("kind != 'random'").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    runs = spans.where("kind = 'random'").join(fixed, "row", "left")
    meets = F.exists("taken", lambda span: (span["start"] < F.col("end")) & (span["end"] > F.col("start")))
    runs = stored(runs.where(~F.coalesce(meets, F.lit(False))).drop("taken"), "runs")
    n, two, three = F.col("n"), F.col("two"), F.col("three")
    couples, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    variance = couples * (two - two * two) + 6 * triples * (three - two * two)
    # The lower tail, as the upper one of the other side, so that small values keep their digits.
    p = F.when(variance > 0, _tail((couples * two - F.col("pairs")) / F.sqrt(variance))).otherwise(1.0)
    tested = _battery(runs).join(F.broadcast(_ordinary(runs)), "encoding").select(
        "row",
        "kind",
        "start",
        "end",
        "uniform",
        p.alias("p"),
        F.concat_ws(" ", "encoding", F.floor(F.log2("n")).cast("string")).alias("stratum"),
    )
    found = _discoveries(stored(tested, "runs-tested"), rate)
    return found.where(F.col("uniform") >= REJECTED).select("row", "kind", "start", "end")


def scan(documents: DataFrame, *, rate: float = RATE) -> DataFrame:
    """(row, doc_id, spans): one row per document, ``spans`` an array of (start, rank, end, kind) in order."""
    texts = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", or_empty("text").alias("text"))
    rows = stored(texts.select("row", "doc_id", F.concat(*[_matches(kind) for kind in KINDS]).alias("matches")), "matches")
    met = rows.where(F.size("matches") > 0)
    spans = stored(_spans(met), "spans")
    every = spans.where("kind != 'random'").drop("run").unionByName(random_runs(spans, rate=rate))
    rank = F.array_position(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind"))
    listed = every.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")
    )
    kind = "array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>"
    return (
        rows.select("row", "doc_id")
        .join(listed, "row", "left")
        .select("row", "doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    )


def report(documents: DataFrame, *, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the fixed forms' spans) and spans (all), as text."""
    found = scan(documents, rate=rate)
    said = lambda spans: F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
