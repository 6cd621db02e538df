"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; a runner may write and reread it between stages. All
but the last give the columns of ``documents``. Defined results for nulls, empty texts, repeated rows and empty
tables are those of the operators that the stages call.
"""

import public_tokenizers

from foliant.llm.common import stored, table
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.minhash import drop_near_copies
from foliant.llm.mixing import mix
from foliant.llm.packing import pack
from foliant.llm.quality_rules import keep_good

#: What two documents share of their word shingles, in percent of all that either has, from which on they are near copies.
NEAR_PERCENT = 80


def quality_stage(spark, docs, sf_dir):
    """Documents that fail the base rule or the classifier go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near copies (from NEAR_PERCENT of shared shingles on) stays."""
    return drop_near_copies(docs, NEAR_PERCENT)


def mixing_stage(spark, docs, sf_dir):
    """Documents in training order, repeated or left out as their source's target weight asks."""
    return mix(docs)


def packing_stage(spark, docs, sf_dir):
    """Where each piece of each document goes."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't train and apply the classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
