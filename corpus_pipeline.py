"""From raw documents to a tokenised training mix.

Every stage works on all rows its predecessor kept, in one table with the columns of ``documents``; only the last returns another
shape. ``run`` writes each stage's rows to the shared folder and reads them back for the next, so a lost executor costs tasks
of one stage only. Extra columns of the documents are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftwise.llm import bpe, jaccard, langid, mixing, pii
from shiftwise.llm.words import unused
from shiftwise.session import work_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: null texts, texts without letters, texts it is too unsure about."""
    names = unused(docs.columns, *langid.ADDED)
    found = langid.identify(docs, langid.fit(docs), keep=docs.columns, names=names)
    return found.where(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, similarity 0.8 or more.

    Of rows that share an id the one with the smallest text stays; rows with a null id belong to no group and stay.
    """
    groups = jaccard.jaccard_components(docs, width=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    order = ["text", *(f"`{f.name}`" for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString())]
    (number,) = unused(docs.columns, "place")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    one = kept.withColumn(number, place).where(F.col(number) == 1).select(*docs.columns)
    return one.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; ``n_chars`` follows the text."""
    base, spans, text = unused(docs.columns, *pii.ADDED)
    found = pii.find_spans(docs, pii.fit(docs), keep=docs.columns, redact=True, added=(base, spans, text))
    changed = F.size(spans) > 0
    new = {"text": F.col(text), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn, 150 % of all words, at most twice each."""
    # The mix orders rows by all their columns and adds some: maps go as their entries, and all under names of their own.
    maps = {f.name for f in docs.schema if f.dataType.typeName() == "map"}
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[(F.map_entries(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    mixed = mixing.mix_sources(plain, weights=(5, 2, 1), share=1.5, cap=2.0, doc=names["doc_id"], text=names["text"], source=names["source"])
    back = mixing.repeated(mixed)
    return back.select(*[(F.map_from_entries(n) if c in maps else F.col(n)).alias(c) for c, n in names.items()])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids)`` of the mixed documents."""
    kept = ["doc_id", "lang", "source"]
    out = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=100_000, keep=kept)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Learned models and the tokenizer are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
