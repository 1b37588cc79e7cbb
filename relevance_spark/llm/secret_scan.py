"""Secrets in texts: fixed patterns, and a battery of randomness tests for whatever else looks drawn at random.

All in one projection of built-in functions. A pattern's matches and the pieces between them give each match's place in
code points. The battery looks at runs of 20 or more characters of the usual encodings that hold digits or inner
capitals; pure numbers are not looked at. '=' is padding at the end and ends a run elsewhere, so that name=VALUE leaves
VALUE. What a run holds of one alphabet is looked at as a whole, from its first part that is no plain word or number
(after a path or an identifier), and between joints ('+', '/', '_', '-'); of discoveries inside one another the longest
counts. For each, the encoding with the smallest alphabet that fits is inferred, and three tests are looked at from both
sides:

* against uniform randomness: chi-squared of the alphabet's uniformity, the number of runs above and below the middle of
  the alphabet, and the serial correlation of neighbours must not reject together (chi-squared of three, BATTERY);
* against ordinary text (shares and habits in ORDINARY): that so many characters are no small letters, that the kind of
  character changes so often, and that small letters follow one another so little. Tail bounds give three p-values that
  fall with the length of the token; Fisher's method combines them.

The combined p-values are controlled as Benjamini and Yekutieli do, so however tokens depend: the words of the text, and
the candidates inside another one, are its hypotheses. So a longer text asks for more, and a longer token gives it.

Null and empty texts hold no secrets. Spans of the battery that touch one of a pattern are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm.shared import let, text_or_empty, word_count

#: Kind, pattern, group whose length counts, and its least length, in order of precedence.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Runs that hold what the battery looks at, and their parts of one alphabet; least length of both with padding.
RUN = r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?"
PLAIN = r"(?<![A-Za-z0-9])(?![A-Za-z]?[a-z]*[0-9]{0,4}[+/_-])"
PARTS = [r"[A-Za-z0-9+/]{16,}=*", r"[A-Za-z0-9_-]{16,}=*", PLAIN + r"[A-Za-z0-9+/]{16,}=*", PLAIN + r"[A-Za-z0-9_-]{16,}=*", r"[A-Za-z0-9]{16,}=*"]
LEAST = 20
#: Alphabets in order of size; the first that holds every character of a token (less padding) is its encoding.
ALPHABETS = [
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Of ordinary text, at most: share of characters that are no small letters, of neighbours of different kinds; at least:
#: correlation of neighbours as to being a small letter. Capitals and figures come at the ends of words.
ORDINARY = {"other": 0.07, "changes": 0.15, "serial": 0.5}
#: Level of the false-discovery control, and the 0.999 quantile of chi-squared with three degrees of freedom.
ALPHA, BATTERY = 0.001, 16.27
MASK = "[SECRET]"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind order, kind, end) of the matches that are long enough."""
    found = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def placed(x: Column) -> Column:
        # One pass over pieces and matches keeps the place that the next match starts at.
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(x["between"][i])
            end = start + F.length(x["match"][i])
            span = F.struct(start.alias("start"), F.lit(_order(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["match"][i].alias("match"))
            return F.struct(F.when(F.length(x["part"][i]) >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"), end.alias("at"))

        none = F.array().cast(_SPANS)
        return F.when(F.size(x["match"]) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(x["match"]) - 1), F.struct(none.alias("spans"), F.lit(0).alias("at")), step)["spans"])

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,match:string>>"
_KINDS = [k for k, *_ in PATTERNS] + ["random"]


def _order(kind: str) -> int:
    return _KINDS.index(kind)


def excess_bits(k: Column, n: Column, share: float) -> Column:
    """-log2 of a bound on the chance that k or more of n are so when each is with at most this share (Chernoff)."""
    rest = n - k
    inside = k * F.log2(F.greatest(k, F.lit(1.0)) / (n * share)) + rest * F.log2(F.greatest(rest, F.lit(1.0)) / (n * (1 - share)))
    return F.when(k > n * share, inside).otherwise(F.lit(0.0))


def serial(v: Column, n: Column) -> Column:
    """Correlation of neighbours; null where all are equal."""
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    spread = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    lagged = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda acc, i: acc + (v[i] - mean) * (v[i - 1] - mean))
    return F.when(spread > 0, lagged / spread)


def ordinary_bits(token: Column) -> Column:
    """-log2 of the combined p-value of three tests against ordinary text."""
    kinds = F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: F.when(c.rlike("[a-z]"), 0.0).when(c.rlike("[A-Z]"), 1.0).when(c.rlike("[0-9]"), 2.0).otherwise(3.0))

    def of(k: Column) -> Column:
        n = F.size(k).cast("double")
        steps = F.sequence(F.lit(1), F.size(k) - 1)
        small = F.transform(k, lambda x: F.when(x == 0, 1.0).otherwise(0.0))
        other = excess_bits(F.size(F.filter(k, lambda x: x != 0)).cast("double"), n, ORDINARY["other"])
        changes = excess_bits(F.size(F.filter(steps, lambda i: k[i] != k[i - 1])).cast("double"), n - 1.0, ORDINARY["changes"])

        def apart(s: Column) -> Column:
            # Normal tail bound of Fisher's transform.
            z = (F.atanh(F.lit(ORDINARY["serial"])) - F.atanh(F.greatest(F.least(s, F.lit(0.999)), F.lit(-0.999)))) * F.sqrt(n - 3.0)
            return F.when(s.isNotNull() & (z > 0), z * z / (2 * math.log(2)) + 1.0).otherwise(F.lit(0.0))

        def fisher(bits: Column) -> Column:
            x = bits * math.log(2)
            return bits - F.log2(1.0 + x + x * x / 2.0)

        return let(other + changes + let(let(small, lambda v: serial(v, n)), apart), fisher)

    return let(kinds, of)


def battery(token: Column) -> Column:
    """Struct of the statistic of three tests and of the bits against ordinary text; null for what no alphabet holds or is a number."""
    bare = F.rtrim(token, F.lit("="))

    def tested(t: Column, alphabet: str) -> Column:
        size = len(alphabet)
        values = F.transform(F.slice(F.split(t, ""), F.lit(1), F.length(t)), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))

        def of(v: Column) -> Column:
            n = F.size(v).cast("double")
            counts = F.transform(F.array_distinct(v), lambda a: F.size(F.filter(v, lambda b: a == b)).cast("double"))
            squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c)
            chi = (squares * size / n - n - (size - 1)) / (2.0 * (size - 1)) ** 0.5
            middle = (size - 1) / 2
            above = F.size(F.filter(v, lambda x: x > middle)).cast("double")
            below = n - above
            steps = F.sequence(F.lit(1), F.size(v) - 1)
            changes = F.size(F.filter(steps, lambda i: (v[i] > middle) != (v[i - 1] > middle))).cast("double")
            mean_runs = 2.0 * above * below / n
            var_runs = F.greatest(mean_runs * (mean_runs - 1) / (n - 1), F.lit(1e-9))
            # All on one side: no runs to count, surely not drawn evenly.
            runs_z = F.when((above == 0) | (below == 0), F.lit(9.0)).otherwise((changes - mean_runs) / F.sqrt(var_runs))
            correlated = F.coalesce(serial(v, n) * F.sqrt(n), F.lit(9.0))
            upper = F.greatest(chi, F.lit(0.0))
            return F.struct((upper * upper + runs_z * runs_z + correlated * correlated).alias("stat"), ordinary_bits(t).alias("bits"))

        return let(values, of)

    def of_token(t: Column) -> Column:
        out = F.lit(None).cast("struct<stat:double,bits:double>")
        for name, alphabet in reversed(ALPHABETS):
            characters = "".join(f"\\{c}" if c in "+/-_" else c for c in alphabet)
            out = F.when(t.rlike(f"^[{characters}]+$"), tested(t, alphabet)).otherwise(out)
        return F.when(t.rlike("^[0-9]*$") | (F.length(t) < 16), F.lit(None)).otherwise(out)

    return let(bare, of_token)


def _apart(candidates: Column, known: Column) -> Column:
    """The candidates that overlap no known span: a pass from either side over both in order, not each against all."""
    kinds = "array<struct<start:int,known:int,span:struct<start:int,rank:int,kind:string,end:int,match:string>>>"
    tagged = lambda spans, order: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("known"), s.alias("span")))
    # At one start, known spans (0) come before candidates (1).
    both = F.sort_array(F.concat(tagged(known, 0), tagged(candidates, 1)))

    def onward(acc: Column, x: Column) -> Column:
        own = x["known"] == 0
        kept = F.when(own | (acc["reach"] <= x["start"]), F.array_append(acc["kept"], x)).otherwise(acc["kept"])
        return F.struct(F.when(own, F.greatest(acc["reach"], x["span"]["end"])).otherwise(acc["reach"]).alias("reach"), kept.alias("kept"))

    def back(acc: Column, x: Column) -> Column:
        own = x["known"] == 0
        kept = F.when(~own & (x["span"]["end"] <= acc["reach"]), F.array_append(acc["kept"], x["span"])).otherwise(acc["kept"])
        return F.struct(F.when(own, x["start"]).otherwise(acc["reach"]).alias("reach"), kept.alias("kept"))

    first = F.aggregate(both, F.struct(F.lit(0).alias("reach"), F.array().cast(kinds).alias("kept")), onward)["kept"]
    second = F.aggregate(F.reverse(first), F.struct(F.lit(2**31 - 1).alias("reach"), F.array().cast(_SPANS).alias("kept")), back)["kept"]
    return F.when((F.size(known) == 0) | (F.size(candidates) == 0), candidates).otherwise(second)


def _outermost(spans: Column) -> Column:
    """The distinct spans that lie in no other one: those that end beyond all that start no later, longer ones first."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s.alias("span"))))

    def step(acc: Column, x: Column) -> Column:
        beyond = x["span"]["end"] > acc["reach"]
        kept = F.when(beyond, F.array_append(acc["kept"], x["span"])).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["reach"], x["span"]["end"]).alias("reach"), kept.alias("kept"))

    folded = F.aggregate(ordered, F.struct(F.lit(-1).alias("reach"), F.array().cast(_SPANS).alias("kept")), step)["kept"]
    return F.when(F.size(spans) <= 1, spans).otherwise(folded)


def _parts(run: Column) -> Column:
    """Spans of a run's parts of one alphabet, in places of the text."""

    def moved(s: Column) -> Column:
        return F.struct((run["start"] + s["start"]).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (run["start"] + s["end"]).alias("end"), s["match"].alias("match"))

    return F.transform(F.array_distinct(F.concat(*[_spans(run["match"], "random", p, 0, LEAST) for p in PARTS])), moved)


def _random_spans(text: Column, words: Column, known: Column) -> Column:
    """Spans of tokens that are random and not prose, beside the known ones."""
    parts = F.flatten(F.transform(_spans(text, "random", RUN, 0, LEAST), _parts))
    candidates = let(F.filter(parts, lambda s: s["match"].rlike("[0-9]|[a-z].*[A-Z]")), lambda c: _apart(c, known))
    return let(candidates, lambda c: _discoveries(c, words + F.size(c) - F.size(_outermost(c))))


def _discoveries(candidates: Column, hypotheses: Column) -> Column:
    scored = F.transform(candidates, lambda s: F.struct(s.alias("span"), battery(s["match"]).alias("b")))
    likely = F.filter(scored, lambda x: x["b"].isNotNull() & (x["b"]["stat"] <= BATTERY) & (x["b"]["bits"] > 0))

    def controlled(x: Column) -> Column:
        # The largest k whose k-th smallest p-value is at most ALPHA k / (m H(m)); all up to it are discoveries.
        bits = F.reverse(F.array_sort(F.transform(x, lambda y: y["b"]["bits"])))
        m = F.greatest(hypotheses, F.lit(1)).cast("double")
        bar = F.log2(m * (F.log(m) + 1.0) / ALPHA)

        def kept(b: Column) -> Column:
            k = F.array_max(F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: b[i - 1] + F.log2(i.cast("double")) >= bar))
            return F.when(k.isNull(), F.array().cast(_SPANS)).otherwise(F.transform(F.filter(x, lambda y: y["b"]["bits"] >= b[k - 1]), lambda y: y["span"]))

        return F.when(F.size(x) == 0, F.array().cast(_SPANS)).otherwise(let(bits, kept))

    return let(let(likely, controlled), _outermost)


def found_secrets(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of docs), ``base`` and ``spans``: arrays of spans in order of start, then kind."""
    text = text_or_empty()
    base = F.sort_array(F.concat(*[_spans(text, *p) for p in PATTERNS]))
    both = let(base, lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _random_spans(text, word_count(text), b))).alias("spans")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), both.alias("found"))
    return rows.select("row", "found.base", "found.spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by MASK and n_chars counted anew where the text changed."""

    def merged(acc: Column, s: Column) -> Column:
        # Spans may overlap; what an earlier one has covered is not written twice.
        fresh = F.struct(F.greatest(s["start"], acc["at"]).alias("start"), s["end"].alias("end"), (s["start"] >= acc["at"]).alias("own"))
        return F.when(s["end"] > acc["at"], F.struct(F.array_append(acc["parts"], fresh).alias("parts"), s["end"].alias("at"))).otherwise(acc)

    found = found_secrets(docs)
    text = F.col("row.text")
    none = F.array().cast("array<struct<start:int,end:int,own:boolean>>")
    parts = F.aggregate("spans", F.struct(none.alias("parts"), F.lit(0).alias("at")), merged)["parts"]

    def written_out(p: Column) -> Column:
        before = lambda i: F.when(i > 0, p[i - 1]["end"]).otherwise(F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.concat(F.substring(text, before(i) + 1, p[i]["start"] - before(i)), F.when(p[i]["own"], F.lit(MASK)).otherwise(F.lit(""))))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(p, -1)["end"] + 1, F.length(text)))

    changed = found.withColumn("_new", F.when(F.size("spans") > 0, let(parts, written_out)))
    columns = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            old = F.coalesce("_new", old)
        elif c == "n_chars":
            old = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return changed.select(columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found_secrets(docs).select("row.doc_id", *[of_kind(k) for k, *_ in PATTERNS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
