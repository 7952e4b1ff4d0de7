"""A training corpus from raw documents: five stages, each written and read again as the next one's documents."""

from blockloom.llm import decontaminate, language, mixing, pii, simhash
from blockloom.llm.common import scratch, stored, table


def identify_language(spark, docs, sf_dir):
    """Documents in no learned language go."""
    return language.keep_known(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_benchmark_documents(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark, docs, sf_dir):
    """Personal data in texts is replaced by its kind."""
    return pii.mask(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents are taken as often as their source's target asks; `copy` counts them."""
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL cannot express a trained classifier; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
