"""Fill-in-middle transformation by escaped marker injection.

Texts are cut into units (a run of ASCII letters, or one other code point). The delimiter and the escape sign are escaped
in the text, a delimiter is appended after every unit, and the delimiters counted; the parts between ranked delimiters
are then taken by substring_index, freed of delimiters, unescaped and put together around the markers. Which ranks
cut, and the form, come from a digest of the doc_id, so a document is always cut alike.

`rebuild` gives the text back from output and form. No marker arises where a part meets a marker: a marker begins
with < and ends with >, and no proper end of one is the beginning of another.

Defined cases: a null text counts as empty and stays plain; texts that hold a marker stay plain; a null doc_id has the digest
of the seed alone; repeated rows give equal rows; texts are read whole; an empty table gives an empty result; further columns pass through,
those named as the result's new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.runtime import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = "1:", 90, 20
DELIMITER, ESCAPE = "\x01", "\x02"
UNIT = f"([A-Za-z]+|{ESCAPE}[01]|[^A-Za-z])"
NEW = ("n", "form", "prefix", "middle", "suffix", "output")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescape(part: Column) -> Column:
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def digest_number(digest: Column, i: int) -> Column:
    """The i-th group of 8 hex digits, from 0, as an unsigned integer."""
    return F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")


def transform(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> DataFrame:
    """`docs` with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain), and output."""
    docs = docs.drop(*NEW)
    t = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], t.alias("t"), escape(t).alias("escaped"), *[digest_number(digest, i).alias(f"h{i + 1}") for i in range(4)]
    )
    rows = rows.withColumn("marked", F.regexp_replace("escaped", UNIT, "$1" + DELIMITER))
    # the marked text is longer than the escaped one by its delimiters
    rows = rows.withColumn("n", (F.char_length("marked") - F.char_length("escaped")).cast("long"))
    ranks = [F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumn("i", F.least(*ranks).cast("int")).withColumn("j", F.greatest(*ranks).cast("int"))
    holds = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("t", F.lit(marker))
    form = F.when((F.col("t") == "") | holds | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    cut = lambda of, count: F.expr(f"substring_index({of}, '{DELIMITER}', {count})")
    part = lambda p: F.when(F.col("form") != "plain", unescape(p))
    parts = rows.select(
        *names.values(), "t", "n", "form", part(cut("marked", "i")).alias("prefix"),
        part(cut(f"substring_index(marked, '{DELIMITER}', j)", "i - j")).alias("middle"), part(cut("marked", "j - n - 1")).alias("suffix"),
    )
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("t")).alias("output")
    return parts.select(*[F.col(n).alias(c) for c, n in names.items()], "n", "form", "prefix", "middle", "suffix", output)


def rebuild(output: Column, form: Column) -> Column:
    """The text from which `transform` made `output`."""
    between = lambda begin, end: F.substring_index(F.substring_index(output, begin, -1), end, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuild(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
numbers AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM docs),
ranks AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM ranks),
made AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256
FROM made
"""
