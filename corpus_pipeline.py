"""A corpus run: reject, dedupe, decontaminate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. What a
stage keeps is written as Parquet below ``spark.checkpoint.dir`` and read by the next one.
"""

from tollwatch.llm import attention, darts, mixing, templates, tokens
from tollwatch.llm.queries import OTHER, TARGETS, tokenizer_path
from tollwatch.session import written


def quality(spark, docs, sf_dir):
    """Documents that the attention classifier does not reject.

    Null and empty texts are scored as texts without words; repeated rows share
    their fate; without documents or labels nothing is learned and all texts get
    one score, so an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return attention.reject_low_quality(docs, attention.fit_quality(docs, labels))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the least id.

    Ties and repeated rows leave one row, the first in the order of the other
    columns; a row without an id stays only where its group has no id. Rows
    without words (null, empty, white space) are no copies and all stay.
    """
    return darts.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; an empty
    benchmark takes nothing away.
    """
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Documents repeated to the target weights of their sources, in random order.

    Null sources count among the others; rows of one id share the number of
    copies, rows without an id go by their text; copies of one row and one
    number have no order among themselves.
    """
    return mixing.mix_sources(docs, TARGETS, OTHER).select(docs.columns)


def token_files(spark, docs, sf_dir):
    """Documents as flat token files, and what is read back from them.

    Null texts are empty and have the end id only; rows of one id stand in the
    order of a hash of their text, those without an id first; an empty table
    gives an index without parts and no rows.
    """
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality), ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate), ("mixing sources", mix),
    ("token files", token_files),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold them against plain forms.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
