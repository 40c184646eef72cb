"""The training-data pipeline: documents in, packed sequences out.

Language identification (documents without a language go), n-gram Jaccard join (one document of
each group stays), secret scan (secrets are masked in place), mixing of sources to target
weights (documents repeat, or stop early at a source's edge), packing into sequences.
"""

from __future__ import annotations

from specloom.llm import language, mixing, ngram_join, packing, secret_scan
from specloom.llm.queries import held_out, tokenizer_path
from specloom.llm.shared import aside, stored, table


def known_language(spark, docs, sf_dir):
    """Documents with a language; one that has no letters has none."""
    def known(df):
        return language.predict(df, language.fit(df, ~held_out()), df.columns).where("lang_pred != 'und'")
    return aside(docs, ["doc_id", "text", "lang"], known)


def without_copies(spark, docs, sf_dir):
    """One document of each group linked by a word 5-gram Jaccard similarity of 0.75 or more."""
    return ngram_join.deduplicated(docs)


def without_secrets(spark, docs, sf_dir):
    """All documents, their secrets masked."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def mixed(spark, docs, sf_dir):
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def packed(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("ngram_join", without_copies), ("secret_scan", without_secrets),
          ("source_mix", mixed), ("sequence_packing", packed)]
#: Learned profiles, the tokenizer and the linear program have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
