"""Fill-in-middle documents by escaped marker injection, in built-in functions alone.

A text is cut into units (spaces and the word after them). One character, the delimiter, is escaped in
the text; ``regexp_replace`` then appends a bare delimiter to every unit, so counting delimiters counts
units, and ``substring_index`` cuts after the k-th unit. Two ranks that a hash of the document's id
decides part the text into prefix, middle and suffix; the parts lose delimiters and escapes again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, the sign that escapes it, and what stands for each of the two in an escaped text.
#: None of them is a space, so an escaped text has the units of the text itself.
DELIMITER, ESCAPE = "\x01", "\x02"
ESCAPED = ((ESCAPE, ESCAPE + "e"), (DELIMITER, ESCAPE + "d"))
SPACES = r"\x20\x09-\x0D"
UNIT = rf"[{SPACES}]*+[^{SPACES}]++|[{SPACES}]++"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(part: Column) -> Column:
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    for plain, code in reversed(ESCAPED):
        part = F.replace(part, F.lit(code), F.lit(plain))
    return part


def drawn(id_col: Column, seed: int, place: int) -> Column:
    """The ``place``-th eight hex digits of a hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def after(text: Column, head: Column) -> Column:
    """What follows ``head``, with which ``text`` begins."""
    return F.substr(text, F.char_length(head) + 1)


def fill_in_middle(df: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rearrange ``fim_percent`` of the texts for training on filling in the middle.

    Returns a row per input row: the id, ``n`` (units), ``form`` and ``output``, and ``prefix``,
    ``middle`` and ``suffix`` (null where the form is plain). Of the rearranged texts ``spm_percent`` put
    the suffix first (``spm``), the others the prefix (``psm``). Empty texts and texts that hold one of
    the marks stay plain. Null texts count as empty, with no units; a null id counts as the empty
    text in the hash, so such rows share their draws; repeated rows repeat; an empty table gives no rows.
    Parts may be empty. Texts of any length are cut whole, within one row.
    """
    text, key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`")
    rows = df.select(key.alias("doc_id"), text.alias("text"), *(drawn(key, seed, i).alias(f"h{i + 1}") for i in range(4)))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + DELIMITER))
    rows = rows.withColumn("n", (F.char_length("marked") - F.char_length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    marks = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | marks[0] | marks[1] | marks[2] | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", "marked", form.alias("form"), F.least(first, second).cast("int").alias("from"), F.greatest(first, second).cast("int").alias("upto"))
    cut = lambda rank: F.when(F.col("form") != "plain", F.call_function("substring_index", F.col("marked"), F.lit(DELIMITER), F.col(rank)))
    rows = rows.select("doc_id", "text", "n", "form", "marked", cut("from").alias("head"), cut("upto").alias("heads"))
    prefix, middle, suffix = F.col("head"), after(F.col("heads"), F.col("head")), after(F.col("marked"), F.col("heads"))
    rows = rows.select("doc_id", "text", "n", "form", unescaped(prefix).alias("prefix"), unescaped(middle).alias("middle"), unescaped(suffix).alias("suffix"))
    parts = {"prefix": F.concat(F.lit(PREFIX), "prefix"), "suffix": F.concat(F.lit(SUFFIX), "suffix"), "middle": F.concat(F.lit(MIDDLE), "middle")}
    psm, spm = (F.concat(*(parts[p] for p in order)) for order in (("prefix", "suffix", "middle"), ("suffix", "prefix", "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", output.alias("output"), "prefix", "middle", "suffix")


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` was given, from its output and form.

    No part holds a mark, and no mark can begin inside another, so the first place of each mark is its own.
    """
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.call_function("substring_index", rest, first, F.lit(1))
    rest = F.substr(rest, F.char_length(one) + len(PREFIX) + 1)
    two = F.call_function("substring_index", rest, second, F.lit(1))
    middle = F.substr(rest, F.char_length(two) + len(PREFIX) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(made: DataFrame) -> DataFrame:
    """Lengths of the parts, and digests of each output and of the text rebuilt from it."""
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


#: The digests in DuckDB: the units as a list, whose slices are the parts.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
    CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM cut),
formed AS (
  SELECT doc_id, text, n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parted AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted"""
