"""Fill-in-middle transformation by lookaround splitting.

A unit grammar is a list of character classes. Characters of a run class that stand side by
side are one unit, any other character is a unit by itself. Such a grammar says where a text
may be cut by looking at the two characters around a place only, so it becomes one regular
expression of zero width, and Spark's ``split`` at it returns every piece and loses none.
Two cuts from a hash of the document's id give prefix, middle and suffix, which are written
with sentinels in prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``) order.
All of it is DataFrame functions in one pass; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_or_empty

#: Run classes of the known grammars, as the inside of a character class; everything else stands alone.
GRAMMARS = {
    "letters": ("A-Za-z",),
    "words": (r"\p{L}\p{M}", r"\p{N}", r"\s"),
    "lines": (r"^\n",),
    "characters": (),
}


def boundary(grammar: str | tuple[str, ...]) -> str:
    """The zero-width expression that matches between two units, never at a text's ends.

    A place is a boundary unless both neighbours are of the same run class: what is before it
    is in no run class, or it is in one and what follows is not in that one.
    """
    runs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    inside = "".join(f"[{run}]" for run in runs)
    alone = f"[^{inside}]" if runs else r"[\s\S]"
    found = [rf"(?<={alone})(?=[\s\S])"]
    found += [rf"(?<=[{run}])(?=[^[{run}]])" for run in runs]
    return "|".join(found)


def units(text: Column, grammar: str | tuple[str, ...] = "letters") -> Column:
    """The units of a text in order; their concatenation is the text, the empty text has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(key: Column, count: int = 4) -> list[Column]:
    """The first ``count`` 8-digit groups of sha256 of ``1:`` and the key's decimal digits, as unsigned numbers."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def transform(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    grammar: str | tuple[str, ...] = "letters",
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    keep: int = 10,
    spm: int = 20,
) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to every row of ``docs``.

    ``sentinels`` stand before prefix, suffix and middle; ``keep`` of 100 texts stay ``plain``,
    ``spm`` of 100 others take that order. Form is ``plain`` as well for empty texts and those
    that hold a sentinel. Null texts are empty, a null key is drawn like an empty one, equal
    keys are cut at places drawn alike, repeated rows come out repeatedly, a table without
    rows gives none. Texts of any length are cut whole. Columns of ``docs`` with the names of the
    added ones are replaced, as is any whose name starts with ``__fim_``.
    """
    if any(not s or any(s[:k] == t[-k:] for t in sentinels for k in range(1, len(s))) for s in sentinels) or any(s in t for i, s in enumerate(sentinels) for j, t in enumerate(sentinels) if i != j):
        raise ValueError("sentinels must not be empty, hold or overlap each other")  # else an output could not be read back
    before, behind, between = (F.lit(s) for s in sentinels)
    docs = docs.drop(*(c for c in docs.columns if c.startswith("__fim_")))
    whole = text_or_empty(text)
    h1, h2, h3, h4 = draws(F.col(key))
    cut = docs.withColumns({"__fim_text": whole, "__fim_units": units(whole, grammar)})
    n = F.size("__fim_units").cast("long")
    cut = cut.withColumns({"__fim_n": n, "__fim_a": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), "__fim_b": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")})
    held = before.isNull()
    for s in sentinels:
        held = held | F.contains("__fim_text", F.lit(s))
    plain = held | (F.col("__fim_n") == 0) | (h3 % 100 >= 100 - keep)
    cut = cut.withColumn("__fim_form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))

    def joined(start: Column, stop: Column) -> Column:
        return F.array_join(F.slice("__fim_units", start + 1, stop - start), "")

    a, b = F.col("__fim_a"), F.col("__fim_b")
    cut = cut.withColumns({"__fim_prefix": joined(F.lit(0), a), "__fim_middle": joined(a, b), "__fim_suffix": joined(b, F.col("__fim_n").cast("int"))})
    parts = {"psm": F.concat(before, "__fim_prefix", behind, "__fim_suffix", between, "__fim_middle"), "spm": F.concat(behind, "__fim_suffix", before, "__fim_prefix", between, "__fim_middle")}
    form = F.col("__fim_form")
    made = cut.withColumns(
        {
            "n": F.col("__fim_n"),
            "form": form,
            "prefix_chars": F.when(form != "plain", F.length("__fim_prefix").cast("long")),
            "middle_chars": F.when(form != "plain", F.length("__fim_middle").cast("long")),
            "output": F.when(form == "plain", F.col("__fim_text")).when(form == "psm", parts["psm"]).otherwise(parts["spm"]),
        }
    )
    return made.drop(*(c for c in made.columns if c.startswith("__fim_")))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``transform`` made ``output`` from, found by the sentinels alone; null stays null."""
    p, s, m = (F.lit(x) for x in sentinels)
    one, two = F.lit(1), F.lit(2)
    head, middle = F.split_part(output, m, one), F.split_part(output, m, two)
    psm = F.concat(F.split_part(F.split_part(head, s, one), p, two), middle, F.split_part(head, s, two))
    spm = F.concat(F.split_part(head, p, two), middle, F.split_part(F.split_part(head, p, one), s, two))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each cut between its letter runs and other characters."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES = {"op11_fim": op11_fim}
ORACLE_SQL = {
    "op11_fim": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || doc_id::VARCHAR) AS h
            FROM documents
        ), c AS (
            SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1)::UBIGINT AS x, ('0x' || h[9:16])::UBIGINT % (len(u) + 1)::UBIGINT AS y,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(x, y)::BIGINT], ''), '') AS a,
                   coalesce(array_to_string(u[least(x, y)::BIGINT + 1:greatest(x, y)::BIGINT], ''), '') AS b,
                   coalesce(array_to_string(u[greatest(x, y)::BIGINT + 1:n], ''), '') AS c
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """
}
