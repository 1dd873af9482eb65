"""Later repeats of line runs, found by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beatframe.functions.lets import let
from beatframe.llm.base import attach, n_words, numbers, stage

BLANK = " \t\n\x0b\x0c\r"


def windows(hashes: str, run: int) -> Column:
    """Every window of ``run`` lines: start, hash of all its lines, and the place of its least line hash (the last of equals)."""
    def one(i):
        place, value = i, F.get(hashes, i)
        for j in range(1, run):
            h = F.get(hashes, i + j)
            place, value = F.when(h <= value, i + j).otherwise(place), F.least(h, value)
        return F.struct(i.cast("int").alias("start"), F.xxhash64(*[F.get(hashes, i + j) for j in range(run)]).alias("window"), place.cast("int").alias("place"),
                        F.lit(run).alias("size"))
    return F.transform(numbers(F.size(hashes) - run + 1), one)


def fingerprints(hashes: str, wins: str, run: int) -> Column:
    """Every selected place once: its hash and the windows that selected it."""
    def one(p):
        near = F.slice(wins, F.greatest(p - run + 2, F.lit(1)), F.lit(run))
        return F.struct(p.alias("place"), F.get(hashes, p).alias("print"), F.filter(near, lambda w: w["place"] == p).alias("around"))
    return F.transform(F.array_distinct(F.transform(wins, lambda w: w["place"])), one)


def long_lines(lines: Column, hashes: Column, words: int) -> Column:
    """A fingerprint of its own for every line of ``words`` words or more, its window the line; no run of lines has the same hash."""
    def one(i):
        alone = F.xxhash64(F.get(hashes, i), F.lit("alone"))
        window = F.struct(i.alias("start"), alone.alias("window"), i.alias("place"), F.lit(1).alias("size"))
        return F.struct(i.alias("place"), alone.alias("print"), F.array(window).alias("around"))
    return F.transform(F.filter(numbers(F.size(hashes)), lambda i: n_words(F.get(lines, i)) >= words), one)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, heavy: int = 1000, alone: int | None = None) -> DataFrame:
    """Delete every line covered by ``run`` consecutive lines that also start earlier in the corpus.

    With ``alone``, every line of that many words or more that also stands earlier is deleted too, whatever its neighbours.

    Lines are cut at \\n; a line with nothing but white space is kept and not counted, so a run may span it. Order is by id (null
    last), then line. Returns row (all given columns, the text as the remaining lines joined by \\n), n_lines, n_removed (counted
    lines only) and gone (their line numbers from 0).

    Of every window of ``run`` lines the least hash is its fingerprint (winnowing), so equal runs of at least that many lines share
    one. Fingerprints found at one place only are dropped; around the others the matches are extended both ways: every window
    holding the fingerprint is compared in full, and all but the first place of equal windows are deleted. Windows are counted
    before the shuffle. First places of the windows that make up over one row in ``heavy`` are at most ``heavy`` rows and are
    broadcast; the rest are joined by key.

    Null texts stay null and have no lines; empty texts have none. Rows that share id and text count as one document and get the
    same result. An empty table gives an empty table. Clashing column names are safe inside ``row``.
    """
    body = F.col("row").getField(text_col)
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != "")

    def selected(h):
        runs = F.when(F.size(h) >= run, let(windows(h, run), lambda w: fingerprints(h, w, run)))
        return runs if alone is None else F.concat(F.coalesce(runs, F.array()), let(full, lambda x: long_lines(x, h, alone)))
    found = let(F.transform(full, lambda x: F.xxhash64(x)), selected)
    prints = stage(d.select("id", "th", F.inline(found)), "prints")
    total = prints.count()
    spread = F.xxhash64("id", "th", "place")
    repeated = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = attach(prints, repeated, ["print"], spread, total, heavy).select("id", "th", "place", "print", F.inline(F.transform(
        "around", lambda w: F.struct(w["start"].alias("start"), w["window"].alias("window"), w["size"].alias("size")))))
    here = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"))
    first = matched.groupBy("print", "window").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")).where("n > 1")
    later = attach(matched, first, ["print", "window"], spread, total, heavy).where(~here.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set(F.struct("start", "size")).alias("starts"))
    j = d.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left")

    def cut(x: Column) -> Column:
        """The text left, the counted lines and the numbers of the removed ones."""
        counted = F.filter(numbers(F.size(x)), lambda i: F.btrim(F.get(x, i), F.lit(BLANK)) != "")
        at = F.coalesce(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))), F.array().cast("array<int>"))
        return let(counted, lambda c: let(F.array_sort(F.transform(at, lambda k: F.get(c, k))), lambda g: F.struct(
            F.concat_ws("\n", F.transform(F.array_except(numbers(F.size(x)), g), lambda i: F.get(x, i))).alias("text"),
            F.size(c).cast("bigint").alias("n_lines"), F.size(g).cast("bigint").alias("n_removed"), g.alias("gone"))))
    r = j.select("row", let(lines, cut).alias("r"))
    return r.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("r.n_removed") == 0, body).otherwise(F.col("r.text"))).alias("row"),
                    "r.n_lines", "r.n_removed", "r.gone")
