"""Raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. Results are written between stages, so
that a lost executor costs one stage's work at most; a stage's table is deleted when
the next one is written.

What holds for every stage: an empty table gives an empty one; texts are taken whole, at
any length; further columns stay as they are, whatever their names (the last stage leaves
them out); rows that repeat are treated alike, except where one of them is to be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import langid, overlap, packing, secrets, substrings
from pitchloom.llm.common import discard, known_to_workers, read, stored, unused

#: A document is rejected if no language stands out by this score.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letters, no text, or no language that stands out.

    Where no language could be learned (no labelled document outside the held-out
    fold, or none with letters) all documents with letters stay.
    """
    known_to_workers(spark)
    learned = langid.fit(docs.where(~langid.held_out(docs)))
    if not learned.slots.any():
        return langid.with_letters(docs).select(docs.columns)
    said, score = unused(docs, "said"), unused(docs, "sure")
    found = langid.predict(docs, learned, (said, score))
    return found.where((found[said] != langid.UNDECIDED) & (found[score] >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group that five-word shingles link at 0.8.

    Texts that are null, empty or blank are linked with nothing and stay, as do rows with a
    null id (which still link others). Of rows that agree in id and text one stays.
    """
    known_to_workers(spark)
    return overlap.keep_one(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out words in windows of 13 that also stand in a document with a smaller id.

    Null texts, those with fewer words and rows with a null id stay as they are. Windows
    are judged on this stage's input; every row stays, though its text may become empty.
    """
    known_to_workers(spark)
    return substrings.without_repeats(docs, 13)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials; no document goes, and a null or empty text stays so."""
    known_to_workers(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens.

    A null or empty text is one piece, the end token. Every row has its pieces, also one
    with a null or repeated id.
    """
    import public_tokenizers

    known_to_workers(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secret_masks),
    ("best_fit_packing", pack),
]

#: Shingle hashes, the automaton and the packing plan have no SQL form; the tests
#: compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
