"""Near copies of documents: SimHash fingerprints over the Gray-order index propose, five-word Jaccard similarity decides.

Shingles. Words of the lower-cased (A-Z) text, sets of five words in a row. Two texts are near copies when their sets have a similarity of at least
0.8; groups are what chains of near copies connect.

Proposals. Every set gets the SimHash fingerprint of its shingles. Sets with equal fingerprints, and those that the Gray-order index (``simhash``) finds within three
bits, are compared first, and those that are linked are connected. At a similarity of 0.8 most pairs differ in more bits, so what the index cannot reach is found by the
partition keys of the exact join (``jaccard_join``), which compares only pairs that the index's links have not connected. The index saves comparisons; the rows are the exact join's.

Defined results. Null or empty text, or text of white space, has no shingles and is nobody's copy. Repeated rows share a group; with several
texts under one id any of them links. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import discard, shippable, stored, unused
from spectraloom.llm.jaccard_join import Join
from spectraloom.llm.shingle_sets import Rule
from spectraloom.llm.simhash import link_codes

RULE = Rule(words=5, percent=80)


def proposals(rows: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are equal or close; ``rows`` has cls, code."""
    codes = stored(rows.groupBy("code").agg(F.min("cls").alias("first")), "near-codes")
    equal = rows.join(codes, "code").where("cls <> first").select(F.col("first").alias("u"), F.col("cls").alias("v"))
    close = link_codes(codes.select("code"), max_bits)
    u, v = (codes.select(F.col("code").alias(f"{k}_code"), F.col("first").alias(f"{k}_first")) for k in "uv")
    close = close.join(u, F.col("u") == F.col("u_code")).join(v, F.col("v") == F.col("v_code"))
    out = stored(equal.unionAll(close.select("u_first", "v_first")).distinct(), "near-proposals")
    discard(codes)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every document; component_id is the least id of its group."""
    join = Join(docs, RULE, id_col, text_col, fingerprints=True)
    close = proposals(join.rows.where("n > 0").select("cls", "code").distinct())
    out = join.finish(join.components(join.links(close)).select("doc_id", "component_id"))
    discard(close)
    return out


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, the one with the least id, with all its columns.

    Documents without an id all stay; documents that share an id stay or go together.
    """
    groups = near_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(unused(docs, "gone_id"))).distinct()
    return docs.join(shippable(gone), F.col(id_col).cast("long") == F.col(gone.columns[0]), "left_anti")
