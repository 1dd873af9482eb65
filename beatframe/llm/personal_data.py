"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from beatframe.functions.lets import let
from beatframe.llm.base import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = {"email": ("plain address", "known domain end", "free edges", "word before", "letter in name", "written out"),
            "ip": ("four parts", "parts to 255", "no leading zero", "word before", "free edges", "public range"),
            "card": ("13 to 19 digits", "check digit", "issuer digit", "word before", "free edges", "grouping"),
            "phone": ("plus sign", "8 to 15 digits", "country code", "word before", "free edges", "grouping")}
VOTES, BITS = 6, 12

#: A candidate matches the base pattern of its kind (which comes first) or a wider one. A wider match never holds the start of a base one.
#: Possessive repeats and the condition on the character before keep every search linear in the text.
EDGE = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
PATTERNS = {
    "email": EDGE + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
             r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
             r"|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)(?![A-Za-z0-9._%+-]*+@)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+|(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9+])\(?[0-9][\x20().0-9-]{5,}[0-9]"}
#: Texts without this hold no candidate of the kind.
GATES = {"email": r"@|[(\[]at[)\]]|\x20dot\x20", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9][\x20().0-9-]+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Gazetteers: ends of domain names, words that announce a span (in four languages), words that announce other numbers, country codes.
DOMAINS = "com|net|org|edu|gov|info|biz|io|eu|de|fr|es|it|uk|us|ch|at|nl|pl|ca|au|jp|cn|br|mx|ru|in"
BEFORE = {"email": "e-?mail|mail|contact|write|kontakt|schreib|courriel|correo|contacto",
          "ip": "ip|host|server|address|addr|adresse|serveur|servidor|login|from",
          "card": "card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|pay",
          "phone": "phone|tel|telephone|call|fax|mobile|telefon|anruf|appel|llame|tel[eé]fono|m[oó]vil"}
OTHER = "version|licen[sc]e|v|section|chapter|page|isbn|order|no|nr|cc by(?:-[a-z]+)*"
COUNTRIES = ("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|"
             "85[0-6]|88[0-6]|96[0-8]|97[0-7]|99[2-8]")


def running_sums(values: Column) -> Column:
    """Sums of an array up to each place, in doubling steps."""
    def step(a, k):
        if k == 30:
            return a
        return F.when(F.size(a) > 2 ** k, let(F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - 2 ** k), F.lit(0))), lambda b: step(b, k + 1))).otherwise(a)
    return let(values, lambda a: step(a, 0))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, value, and the text around them up to the matches beside."""
    def place(found, pieces):
        size = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.length(p) + F.length(v))
        return let(running_sums(size), lambda ends: F.transform(found, lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"),
            F.substring(F.get(pieces, i), -24, 24).alias("before"), F.substring(F.get(pieces, i + 1), 1, 8).alias("after"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda pieces: place(found, pieces)))


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: let(F.coalesce(x.cast("int"), F.lit(0)), lambda d: F.when(
        i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def said(before: Column, words: str) -> Column:
    """One of the words stands at the end of the text before, but for up to eight other characters without a letter."""
    return F.rlike(before, F.lit(rf"(?i)(?<![\p{{L}}0-9])(?:{words})[^\p{{L}}\n]{{0,8}}$"))


def vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 no vote."""
    out = F.when(yes, 2)
    return F.when(yes, 2).otherwise(0) if no is None else out.when(no, 0).otherwise(1)


def is_base(kind: str, v: Column, digits: Column) -> Column:
    size = F.length(digits)
    return {"email": F.contains(v, F.lit("@")), "ip": F.rlike(v, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), "card": size.between(16, 19) & luhn(digits),
            "phone": F.startswith(v, F.lit("+")) & size.between(8, 15)}[kind]


def votes(kind: str, v: Column, digits: Column, before: Column, after: Column) -> list[Column]:
    """One vote per labeler of LABELERS; patterns, gazetteers and context."""
    size, never = F.length(digits), F.lit(False)

    def like(p):
        return F.rlike(v, F.lit(p))
    context = vote(said(before, BEFORE[kind]), said(before, OTHER) | F.rlike(after, F.lit(r"^\x20?(?:%|€|\$|km|kg|pages?\b)")))
    free = vote(~F.rlike(before, F.lit(r"[\p{L}0-9_.\-]$")) & ~F.rlike(after, F.lit(r"^(?:[\p{L}0-9_]|\.[0-9])")))
    if kind == "email":
        return [vote(F.contains(v, F.lit("@"))), vote(like(rf"(?i)(?:\.|dot[)\]]?\x20)(?:{DOMAINS})$"), never), free, context,
                vote(like(r"^[^@(\[\x20]*[A-Za-z]")), vote(like(r"[(\[](?:at|dot)[)\]]"), like(r"\x20at\x20"))]
    if kind == "ip":
        return [vote(like(r"^[0-9]+(?:\.[0-9]+){3}$")), vote(like(rf"^{OCTET}(?:\.{OCTET})*$")), vote(~like(r"(?:^|\.)0[0-9]")), context, free,
                vote(like(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-1][0-9]|22[0-3])\.[0-9]+\.[0-9]+\.[0-9]+$"), ~like(r"^[0-9]+(?:\.[0-9]+){3}$"))]
    if kind == "card":
        check = vote(F.when(size.between(13, 19), luhn(digits)).otherwise(F.lit(False)), never)
        return [vote(size.between(13, 19)), check, vote(F.rlike(digits, F.lit("^[2-6]"))), context, free,
                vote(like(r"^[0-9]{13,19}$|^[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4})+(?:\1[0-9]{1,3})?$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$"))]
    return [vote(F.startswith(v, F.lit("+")), never), vote(size.between(8, 15)), vote(like(rf"^\+(?:{COUNTRIES})(?![0-9]{{13}})"), F.startswith(v, F.lit("+"))), context, free,
            vote(like(r"^\+?[0-9]{0,3}[\x20.-]?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-][0-9]{2,5}){1,4}$") & ~like(r"^[0-9]+(?:\.[0-9]+){3}$"))]


def traits(v: Column, digits: Column, before: Column, after: Column) -> list[Column]:
    """Yes/no inputs of the span classifier: the shape of the span and of what stands around it."""
    size = F.length(digits)

    def like(p):
        return F.rlike(v, F.lit(p))
    return [size >= 8, size >= 13, size >= 16, size > 19, like("[A-Za-z]"), F.contains(v, F.lit("@")), like(r"[\x20()-]"), like(r"^[0-9]+(?:\.[0-9]+){3}$"),
            F.rlike(before, F.lit(r"[\p{L}0-9_.\-]$")), F.rlike(after, F.lit(r"^(?:[\p{L}0-9_]|\.[0-9])")), F.startswith(v, F.lit("+")),
            said(before, "|".join(BEFORE.values()))]


def code(parts: list[Column], base: int) -> Column:
    return sum((p.cast("int") * base ** i for i, p in enumerate(parts)), F.lit(0))


def candidates(text: Column, kind: str) -> Column:
    """Array of (start, end, base, votes, traits) of one kind, by start."""
    def one(s):
        return let(F.regexp_replace(s["value"], "[^0-9]", ""), lambda d: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), is_base(kind, s["value"], d).alias("base"),
            code(votes(kind, s["value"], d, s["before"], s["after"]), 3).alias("votes"), code(traits(s["value"], d, s["before"], s["after"]), 2).alias("traits")))
    found = F.when(F.rlike(text, F.lit(GATES[kind])), F.transform(spans(text, PATTERNS[kind]), one))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int,base:boolean,votes:int,traits:int>>"))


def total(a: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + value(x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def digit(c: Column, i: int, base: int) -> Column:
    return F.floor(c / base ** i).cast("int") % base


def log_ratios(patterns: Column, shares: Column, even: float = 1.0) -> Column:
    """Log prior ratio, then per labeler and vote the log of how much likelier it is on personal data; from patterns (votes, n) and the
    share of each that is personal data."""
    def table(z):
        n1, n0 = total(z, lambda x: x["n"] * x["r"]), total(z, lambda x: x["n"] * (1 - x["r"]))

        def entry(j, v):
            hit = [total(z, lambda x, w=w: F.when(digit(x["votes"], j, 3) == v, x["n"] * w(x["r"])).otherwise(0.0)) for w in (lambda r: r, lambda r: 1 - r)]
            return lambda n: F.log((hit[0] + even) / (n["a"] + 3 * even)) - F.log((hit[1] + even) / (n["b"] + 3 * even))
        return let(F.struct(n1.alias("a"), n0.alias("b")), lambda n: F.array(F.log((n["a"] + even) / (n["b"] + even)), *[
            entry(j, v)(n) for j in range(VOTES) for v in range(3)]))
    return let(F.zip_with(patterns, shares, lambda p, r: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), r.alias("r"))), table)


def posterior(patterns: Column, ratios: Column) -> Column:
    return F.transform(patterns, lambda p: sigmoid(sum((F.get(ratios, 1 + 3 * j + digit(p["votes"], j, 3)) for j in range(VOTES)), F.get(ratios, 0))))


def estimate(patterns: Column, rounds: int) -> Column:
    """Share of each vote pattern that is personal data: expectation-maximisation from the majority of the votes."""
    first = F.transform(patterns, lambda p: sigmoid(sum((digit(p["votes"], j, 3).cast("double") - 1 for j in range(VOTES)), F.lit(0.0))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda r, _: let(log_ratios(patterns, r), lambda t: posterior(patterns, t)))


def fit_classifier(shapes: Column, rounds: int, rate: float = 1.2, decay: float = 1e-3) -> Column:
    """Weights (constant first) of a logistic regression on (traits, n, y), by gradient steps on the mean loss."""
    def step(w, _):
        def slope(z, i):
            pull = total(z, lambda x: x["e"] if i == 0 else x["e"] * digit(x["traits"], i - 1, 2))
            return F.get(w, i) - rate * (pull + (decay * F.get(w, i) if i else F.lit(0.0)))
        errors = F.transform(shapes, lambda x: F.struct(x["traits"].alias("traits"), (x["n"] * (sigmoid(scored(x["traits"], [F.get(w, i) for i in range(BITS + 1)])) - x["y"])).alias("e")))
        return let(errors, lambda z: F.array(*[slope(z, i) for i in range(BITS + 1)]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.0)] * (BITS + 1)), step)


def scored(bits: Column, w: list) -> Column:
    return sum((digit(bits, i, 2) * w[i + 1] for i in range(BITS)), F.lit(0.0) + w[0])


def learn(found: DataFrame, rounds: int = 40, steps: int = 300) -> DataFrame:
    """kind, labelers (log ratios after the last round) and weights of the span classifier, from all candidates (kind, votes, traits).

    Candidates are counted by votes and traits before the shuffle, so the estimates see at most 729 vote patterns and 4,096 shapes a kind,
    whatever the size of the corpus.
    """
    counts = stage(found.groupBy("kind", "votes", "traits").agg(F.count(F.lit(1)).cast("double").alias("n")), "votes")
    by_votes = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    shares = stage(by_votes.withColumn("r", estimate(F.col("p"), rounds)).withColumn("labelers", log_ratios(F.col("p"), F.col("r"))), "shares")
    each = shares.select("kind", F.inline(F.arrays_zip(F.col("p.votes").alias("votes"), F.col("r").alias("y"))))
    shapes = counts.join(F.broadcast(each), ["kind", "votes"]).groupBy("kind", "traits").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("y"))
    shapes = shapes.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("traits", "n", "y"))).alias("s"))
    share = let(total(F.col("s"), lambda x: x["n"]), lambda n: F.transform("s", lambda x: F.struct(x["traits"].alias("traits"), (x["n"] / n).alias("n"), x["y"].alias("y"))))
    shapes = stage(shapes.select("kind", share.alias("s")), "shapes")
    return shares.select("kind", "labelers").join(shapes.select("kind", fit_classifier(F.col("s"), steps).alias("weights")), "kind")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, spans (arrays of kind, start, end, base and score by kind, then start; code points, end exclusive), one row per document.

    Candidates of each kind are the leftmost non-overlapping matches of its base pattern and of a wider one. Base matches that pass their
    checks (parts to 255, 16 to 19 digits with a right check digit, 8 to 15 digits) are always spans. On every candidate six labelers
    (patterns, gazetteers, context) vote for, against or not at all; expectation-maximisation over the counts of all vote patterns of the
    corpus estimates how reliable each is, which gives soft labels; a logistic regression on the candidates' shapes learns from these and
    decides on the candidates that are not base matches: score at least ``least``. So a number with the form of a card is found though
    its check digit is wrong, and a version number is left.

    Null and empty texts have no spans. Repeated rows are judged alike and count each time. A kind without a candidate in the table learns
    nothing and has none. An empty table gives an empty table. Other columns are not read. The texts are read once; candidates go to a
    stored stage without the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), *[candidates(text, k).alias(k) for k in KINDS]), "candidates")

    def named(k):
        return F.transform(k, lambda c: F.struct(F.lit(k).alias("kind"), c["votes"].alias("votes"), c["traits"].alias("traits")))
    weights = {r["kind"]: list(r["weights"]) for r in learn(rows.select(F.inline(F.concat(*map(named, KINDS))))).collect()}  # 13 numbers a kind

    def judged(k):
        score = (lambda c: sigmoid(scored(c["traits"], weights[k]))) if k in weights else (lambda c: F.lit(0.0))
        return F.transform(k, lambda c: F.struct(F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score(c).alias("score")))
    return rows.select("doc_id", F.filter(F.concat(*[judged(k) for k in KINDS]), lambda s: s["base"] | (s["score"] >= least)).alias("spans"))


def joined(spans_col: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
