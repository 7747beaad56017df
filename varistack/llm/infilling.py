"""Fill-in-the-middle transformation by counted quantifiers.

``regexp_count`` gives a text's number of units n. Two draws cut them at a <= b; the row's own pattern,
``unit`` counted a times, then b - a times, then the rest, captures prefix, middle and suffix in one
match, whose groups ``regexp_replace`` puts in the order of the row's form. Counted groups are
possessive: they never give units back, so a match keeps no stack of them however many a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines with their line feed; the last one may lack it.
UNIT = "[^\\n]*\\n|[^\\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Markers and groups of the match, in the order of each form.
FORMS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``(id_col, n, form, output)``: one row per input row, repeated rows and ids included.

    ``unit`` is a Java regex without groups of its own that matches any text from left to right without gaps. ``form`` is
    plain (the text as it is) if the text is null or empty, holds one of the markers or is not among the
    ``percent``; else spm for ``spm_percent`` of the rest, or psm. A null id draws as an empty one. An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(_draws(id_col, seed), 1)))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= percent)
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    cut, other = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    rows = rows.select("id", "text", "n", F.least(cut, other).alias("a"), F.greatest(cut, other).alias("b"), F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    counted = "((?:" + unit + "){%d}+)"
    pattern = F.format_string(f"(?s)\\A{counted}{counted}(.*)\\z", "a", F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", FORMS["spm"]).otherwise(FORMS["psm"])
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select(F.col("id").alias(id_col), "n", "form", output.alias("output"))


def parts(output: str = "output", form: str = "form") -> dict[str, Column]:
    """``prefix``, ``middle`` and ``suffix`` of an output, null if plain.

    No marker is in a text that has been cut, and none can begin inside another, so the first place at
    which each stands is its own.
    """
    first = F.substring(output, len(PREFIX) + 1, 2**31 - 1)  # both forms begin with a marker
    lead, rest = (F.substring_index(first, m, n) for m, n in ((SUFFIX, 1), (SUFFIX, -1)))
    psm = {"prefix": lead, "suffix": F.substring_index(rest, MIDDLE, 1), "middle": F.substring_index(rest, MIDDLE, -1)}
    lead, rest = (F.substring_index(first, m, n) for m, n in ((PREFIX, 1), (PREFIX, -1)))
    spm = {"suffix": lead, "prefix": F.substring_index(rest, MIDDLE, 1), "middle": F.substring_index(rest, MIDDLE, -1)}
    return {k: F.when(F.col(form) == "psm", psm[k]).when(F.col(form) == "spm", spm[k]) for k in ("prefix", "middle", "suffix")}


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Adds ``prefix``, ``middle``, ``suffix`` and ``restored``, the exact text, from output and form alone."""
    own = parts(output, form)
    rows = rows.withColumns(own)
    return rows.withColumn("restored", F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat("prefix", "middle", "suffix")))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    from varistack.llm.common import table

    rows = restore(infill(table(spark, sf_dir, "documents")))
    sizes = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units
  from documents
), cut as (
  select *, len(units) as n, ('0x' || substr(h, 1, 8))::bigint % (len(units) + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (len(units) + 1) as y,
         ('0x' || substr(h, 17, 8))::bigint % 100 as r, ('0x' || substr(h, 25, 8))::bigint % 100 as s
  from drawn
), parts as (
  select doc_id, n, text,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r >= 100 then 'plain' when s < 50 then 'spm' else 'psm' end as form,
         array_to_string(units[1:least(x, y)], '') as prefix,
         array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as middle,
         array_to_string(units[greatest(x, y) + 1:], '') as suffix
  from cut
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
