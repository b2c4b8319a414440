"""Fill-in-middle transformation by relational units: a text is cut before two of its units, and its pieces change places.

Units are the matches of a pattern, left to right; a character that the pattern does not match is a unit of its own, so
units cover the text. All steps are DataFrame operations. The unit relation has a row per unit near a cut and one per
``RUN`` units elsewhere: no cut falls into such a run, so its units need not be told apart, and a text costs rows in
proportion to its length through ``RUN``. A running sum over a document's rows gives each unit its ordinal and its end,
cut requests join on the ordinal, offsets are aggregated per document, and ``substring`` cuts. Texts move once, to the
partition of their key; the running sums, the joins and the aggregates all use that partitioning.

Defined cases: a null text is empty; an empty text, one that contains a marker and the share that ``plain_percent`` leaves
stay as they are (form ``plain``). A null id counts as the text ``null`` in the hash that draws cuts and form. Rows equal in
id and text get equal results, each its own row; rows of one id with different texts are told apart. An empty table gives
an empty result. Other columns, whatever their names, are ignored. Patterns must decide by the matched text alone (no
look-around), as runs are matched apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any character, a code point.
CHARACTER = "(?s:.)"
#: Units in a row of the unit relation away from cuts.
RUN = 64
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred documents: those cut, and of these those with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20


def _draw(id_col: Column, i: int, seed: int) -> Column:
    """The i-th group of eight hexadecimal digits of a hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _pattern(unit: str) -> str:
    return unit if unit == CHARACTER else f"(?:{unit}|{CHARACTER})"


def cut_requests(docs: DataFrame, unit: str, cut_percent: int, suffix_first_percent: int, seed: int) -> DataFrame:
    """Per row: key, text, its number n of units, form, and the two unit ordinals after which prefix and middle end.

    Rows that share a key are equal; they lie in one partition, by key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    # known to be there, so that no filter on it moves below the exchange either
    t = docs.select("doc_id", text.alias("text"), F.coalesce(F.unhex(key), F.lit(b"")).alias("key")).repartition("key")
    n = F.length("text") if unit == CHARACTER else F.regexp_count("text", F.lit(_pattern(unit)))
    t = t.withColumn("n", n.cast("long"))
    draws = [_draw(F.col("doc_id"), i, seed) for i in range(4)]
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (draws[2] % 100 >= cut_percent), "plain").when(draws[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    t = t.withColumns({"form": form, "u": draws[0] % (F.col("n") + 1), "v": draws[1] % (F.col("n") + 1)})
    return t.select("key", "doc_id", "text", "n", "form", F.least("u", "v").alias("first"), F.greatest("u", "v").alias("second"))


def _if_cut(array: Column, kind: str) -> Column:
    """No elements for a plain text. As a filter, this would move below the exchange of texts, and each branch would make its own exchange."""
    return F.when(F.col("form") != "plain", array).otherwise(F.array().cast(kind))


def unit_rows(t: DataFrame, unit: str, run: int = RUN) -> DataFrame:
    """The unit relation of the rows to cut: key, position, number of units, characters; equal rows count once."""
    one = _pattern(unit)
    runs = F.regexp_extract_all("text", F.lit(f"{one}{{1,{run}}}+"), F.lit(0))

    def row(units: Column, chars: Column) -> Column:
        return F.struct(units.cast("int").alias("units"), chars.cast("int").alias("chars"))

    def spread(piece: Column, i: Column) -> Column:
        """Single units where a cut lies behind one of them, else one row; all runs but the last have ``run`` units."""
        hit = F.col("first").between(i * run + 1, (i + 1) * run) | F.col("second").between(i * run + 1, (i + 1) * run)
        single = F.transform(F.regexp_extract_all(piece, F.lit(one), F.lit(0)), lambda c: row(F.lit(1), F.length(c)))
        whole = F.array(row(F.least(F.lit(run).cast("long"), F.col("n") - i.cast("long") * run), F.length(piece)))
        return F.when(hit, single).otherwise(whole)

    rows = t.select("key", F.posexplode(_if_cut(F.flatten(F.transform(runs, spread)), "array<struct<units:int,chars:int>>")).alias("pos", "u"))
    return rows.groupBy("key", "pos").agg(F.first("u.units").alias("units"), F.first("u.chars").alias("chars"))


def cut_offsets(t: DataFrame, unit: str, run: int = RUN) -> DataFrame:
    """Per key: characters before the end of the prefix and of the middle."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = unit_rows(t, unit, run).select("key", "units", F.sum("units").over(so_far).alias("ordinal"), F.sum(F.col("chars").cast("long")).over(so_far).alias("end"))
    requests = t.select("key", F.explode(_if_cut(F.array("first", "second"), "array<bigint>")).alias("asked"), "first", "second")
    # a cut's unit is a row of its own; asking by range keeps the join on the key, by which all is partitioned already
    found = units.join(requests, "key").filter((F.col("asked") <= F.col("ordinal")) & (F.col("asked") > F.col("ordinal") - F.col("units")))
    at = lambda which: F.max(F.when(F.col("asked") == F.col(which), F.col("end")))
    return found.groupBy("key").agg(at("first").alias("a"), at("second").alias("b"))


def fill_in_middle(
    docs: DataFrame, unit: str = CHARACTER, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: int = 1, run: int = RUN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, number n of units, form, prefix_chars and middle_chars (null if plain), and the transformed text as ``output``."""
    t = cut_requests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), unit, cut_percent, suffix_first_percent, seed)
    both = t.join(cut_offsets(t, unit, run), "key", "left")
    cut = F.col("form") != "plain"
    # a cut before the first unit has no row to end at
    both = both.withColumns({"a": F.when(cut, F.coalesce("a", F.lit(0))), "b": F.when(cut, F.coalesce("b", F.lit(0)))})
    prefix, middle = F.substring("text", F.lit(1), F.col("a").cast("int")), F.substring("text", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substring("text", F.col("b").cast("int") + 1, F.length("text"))
    p, s, m = map(F.lit, MARKERS)
    output = F.when(~cut, F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return both.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: its markers stand three times in it, as no text with a marker was cut."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def fill_in_middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_in_middle`` by characters, with digests of the output and of the text restored from it."""
    t = fill_in_middle(docs, id_col=id_col, text_col=text_col)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
