"""Offsets within a text: running lengths, and references matched to tokens.

The as-of match of references to tokens is a forward fill over the sorted
union of both, no range join. Offsets are cut into blocks of fixed width, each
block is filled by itself, and one row per block carries the last token on. A
window holds at most the offsets of one block, or the blocks of one text, so a
single huge text spreads over many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlift.functions.rows import unnest
from editlift.session import broadcast_if_small

BLOCK = 1 << 16

#: A token is a run of letters and digits or any other visible character; runs of blanks lie between.
BLANK = r"[ \t\n\x0B\f\r]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]"
TOKEN_OR_BLANK = TOKEN + "|" + BLANK

#: Characters of a text whose starts are listed at once.
PART = 4_096
START_MARK = "\u0001"


def running_starts(df: DataFrame, *key: str, length: str, pos: str = "pos", out: str = "start") -> DataFrame:
    """Adds the start offset of each piece: the summed length of those before it."""
    before = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(before), F.lit(0)))


def token_starts(text: Column) -> Column:
    """Array of the offsets, in characters, at which the tokens of a text start.

    Letters and digits become one sign and then every first one of a run, like any other visible character, a mark:
    one character for one, so a mark stands where its token starts. The marks are read off in parts of fixed length.
    """
    signs = F.regexp_replace(text, r"[\p{L}\p{N}]", "a")
    marks = F.regexp_replace(signs, r"(?<!a)a|[^a \t\n\x0B\f\r]", START_MARK)
    parts = F.regexp_extract_all(marks, F.lit(f"(?s).{{1,{PART}}}"), 0)

    def starts(part: Column, n: Column) -> Column:
        at = F.transform(F.split(part, ""), lambda c, i: F.when(c == START_MARK, n.cast("long") * PART + i))
        return F.filter(at, lambda x: x.isNotNull())

    return F.flatten(F.transform(parts, starts))


def tokens_of(df: DataFrame, *key: str, text_col: str = "text") -> DataFrame:
    """(key, tok_start, token): the tokens of a text with their offset in characters.

    A null or blank text has no tokens. A text whose key is its own is cut in the row, without a shuffle. Texts that share a
    key, null included, are counted on in one window, as ``running_starts`` does; one job over the keys finds these.
    """
    repeated = df.groupBy(*key).count().where("count > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    if not repeated.limit(1).count():
        return _own_tokens(df, *key, text_col=text_col)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    repeated = broadcast_if_small(repeated)
    own = _own_tokens(df.join(repeated, same, "left_anti"), *key, text_col=text_col)
    return own.unionByName(_tokens_by_window(df.join(repeated, same, "left_semi"), *key, text_col=text_col))


def _own_tokens(df: DataFrame, *key: str, text_col: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), 0)
    pairs = F.arrays_zip(token_starts(F.col(text_col)).alias("tok_start"), tokens.alias("token"))
    rows = unnest(df.select(*key, pairs.alias("_tokens")), *key, array="_tokens", value="_t")
    return rows.select(*key, "_t.tok_start", "_t.token")


def _tokens_by_window(df: DataFrame, *key: str, text_col: str) -> DataFrame:
    """Tokens and the blanks between them cover the text, so the offset is a running length over the texts of a key."""
    parts = df.select(*key, F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_OR_BLANK), 0).alias("_parts"))
    rows = unnest(parts, *key, array="_parts", value="token").withColumns(
        {"_length": F.length("token"), "_blank": F.col("token").rlike(f"^{BLANK}")}
    )
    placed = running_starts(rows, *key, length="_length", out="tok_start")
    return placed.where(~F.col("_blank")).select(*key, "tok_start", "token")


def _filled(tokens: DataFrame, references: DataFrame, key: str, block: int) -> DataFrame:
    """Distinct offsets with whether a token starts there (``is_token``), the number of references there
    (``n_refs``), the last token at or before (``tok``) and, for a token, whether a reference comes before
    the next one (``ref_next``).

    Both are one column (``_code``: twice the references, plus one for a token), so that rows and blocks need the
    same columns of the events. These are dealt out by block once, and Spark uses that exchange for both.
    """
    events = (
        tokens.select(key, F.col("tok_start").alias("at"), F.lit(1).alias("_token"), F.lit(0).alias("_ref"))
        .unionByName(references.select(key, F.col("ref_pos").alias("at"), F.lit(0).alias("_token"), F.lit(1).alias("_ref")))
        .where(F.col("at").isNotNull())
        .groupBy(key, "at")
        .agg((2 * F.sum("_ref") + F.max("_token")).alias("_code"))
        # Never null, and said so: else the join's test for nulls goes below one of the two exchanges.
        .withColumn("_block", F.coalesce(F.floor(F.col("at") / block), F.lit(0)))
        .repartition(key, "_block")
    )
    in_block = Window.partitionBy(key, "_block").orderBy("at")
    is_token = F.col("_code") % 2 == 1
    token_at = F.when(is_token, F.col("at"))
    local = events.withColumn("_tok", F.last(token_at, ignorenulls=True).over(in_block)).withColumn(
        "_next", F.lead(~is_token).over(in_block)
    )
    blocks = events.groupBy(key, "_block").agg(
        F.max(token_at).alias("_last"), F.min(F.struct("at", (~is_token).alias("ref"))).alias("_first")
    )
    over_blocks = Window.partitionBy(key).orderBy("_block")
    carried = blocks.select(
        key,
        "_block",
        F.last("_last", ignorenulls=True)
        .over(over_blocks.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry"),
        F.lead("_first.ref").over(over_blocks).alias("_first_after"),
    )
    return local.join(carried, [key, "_block"]).select(
        key,
        "at",
        is_token.alias("is_token"),
        F.shiftright("_code", 1).alias("n_refs"),
        F.coalesce("_tok", "_carry").alias("tok"),
        ((F.col("_code") > 1) | F.coalesce("_next", "_first_after", F.lit(False))).alias("ref_next"),
    )


def flag_tokens(tokens: DataFrame, references: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, tok_start, reference): is there a reference before the next token."""
    return (
        _filled(tokens, references, key, block)
        .where("is_token")
        .select(key, F.col("at").alias("tok_start"), F.col("ref_next").alias("reference"))
    )


def token_of_reference(tokens: DataFrame, references: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, ref_pos, n_refs, tok_start): last token at or before each reference offset.

    References at one offset share a row and are counted; null where no token
    comes before.
    """
    return (
        _filled(tokens, references, key, block)
        .where("n_refs > 0")
        .select(key, F.col("at").alias("ref_pos"), "n_refs", F.col("tok").alias("tok_start"))
    )
