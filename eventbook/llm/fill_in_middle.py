"""Operator 12: texts rearranged so that a model learns to fill in their middle.

A text is a run of units: words of Latin letters and single other characters.  ``regexp_count`` gives
their number n; two hashes of the row's id choose the places a <= b between units where prefix and middle
end.  A pattern made for the row, ``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``, captures the three parts in one
match, and its replacement writes them in their new order.  The quantifiers are possessive: the match runs
through the text once, without stack or way back, however long the text is.  Nothing is shuffled.

A text that is empty or contains one of the markers, and a share of the others, stays plain.  Since no
rearranged text contains a marker of its own, the marked form splits into its parts again, and
``restored`` puts them together.

Cases: a null text counts as empty; a null id counts as an empty one, so that rows without an id are cut by
the same hashes; repeated rows and rows that share an id are treated alike; an empty table gives an
empty result; columns named like a result column are replaced, all others are carried.  All steps are DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: units, markers, and of 100 parts those that are rearranged, and of these suffix first.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKED, SUFFIX_FIRST = 90, 20
SEED = "1"


def numbers(doc_id: Column, seed: str) -> list[Column]:
    """The first four numbers of eight hexadecimal digits in the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(text: Column, prefix_units: Column, middle_units: Column, suffix_first: Column) -> Column:
    """Prefix, middle and suffix of the text in their new order, each behind its marker."""
    count = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), count(prefix_units), count(middle_units), F.lit(r"(.*)\z"))
    order = F.when(suffix_first, f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    return F.regexp_replace(text, pattern, order)


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a rearranged text."""
    split = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second = F.get(split, F.lit(1)), F.get(split, F.lit(2))
    spm = form == "spm"
    return F.when(spm, second).otherwise(first), F.get(split, F.lit(3)), F.when(spm, first).otherwise(second)


def restored(output: Column, form: Column) -> Column:
    """The original text of an output and its form."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form)))


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = SEED, marked: int = MARKED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The documents with ``n`` (long), ``form`` (plain, psm, spm), ``output``, ``prefix_chars`` and
    ``middle_chars`` (long, null if plain)."""
    results = ("n", "form", "output", "prefix_chars", "middle_chars")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in results or c in (id_column, text_column)))
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = numbers(F.col(f"`{id_column}`"), seed)
    holds_marker = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | holds_marker | (h3 % 100 >= marked)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    counted = docs.withColumns({"fim_text_": text, "fim_n_": F.regexp_count(text, F.lit(UNIT)).cast("long"), "fim_form_": form, "fim_1_": h1, "fim_2_": h2})
    one, two = F.col("fim_1_") % (F.col("fim_n_") + 1), F.col("fim_2_") % (F.col("fim_n_") + 1)
    placed = counted.withColumns({"fim_a_": F.least(one, two), "fim_b_": F.greatest(one, two)})
    is_plain = F.col("fim_form_") == "plain"
    new = rearranged(F.col("fim_text_"), F.col("fim_a_"), F.col("fim_b_") - F.col("fim_a_"), F.col("fim_form_") == "spm")
    made = placed.withColumn("fim_output_", F.when(is_plain, F.col("fim_text_")).otherwise(new))
    prefix, middle, _ = parts(F.col("fim_output_"), F.col("fim_form_"))
    length = lambda part: F.when(~is_plain, F.char_length(part)).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    return made.select(*kept, F.col("fim_n_").alias("n"), F.col("fim_form_").alias("form"), F.col("fim_output_").alias("output"), length(prefix).alias("prefix_chars"), length(middle).alias("middle_chars"))


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns of ``fill_in_middle``'s rows: hashes in place of texts."""
    done = fill_in_middle(docs)
    of = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", of(F.col("output")).alias("output_sha256"), of(back).alias("restored_sha256"))


#: The same rows by lists of units; for DuckDB.
ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM {documents}
), placed AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
